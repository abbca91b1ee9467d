"""Text operators over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import text as ot
from ..plans.text import prepare_text
from ..session import materialize
from .common import (
    documents, r6, raw_documents, sql_list, sql_r6, with_docs,
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


@query(
    "p7_length_filter",
    with_docs(
        """SELECT doc_id, length(cleaned_text) AS n_chars FROM docs
           WHERE length(cleaned_text) BETWEEN 100 AND 5000"""
    ),
)
def p7(spark, d):
    cleaned = ot.add_clean_text(raw_documents(spark, d))
    return ot.keep_length_between(cleaned, 100, 5000).select(
        "doc_id", F.length("cleaned_text").cast("long").alias("n_chars")
    )


@query(
    "t1_clean_text",
    with_docs("SELECT doc_id, md5(cleaned_text) AS digest FROM docs"),
)
def t1(spark, d):
    return ot.add_clean_text(raw_documents(spark, d)).select(
        "doc_id", F.md5("cleaned_text").alias("digest")
    )


# The documents have no clinical headers: put each one's text under some.
_NOTE = (
    "'seen by ' || source || chr(10) || 'Chief Complaint:' || chr(10) || text || chr(10)"
    " || 'ALLERGIES ' || chr(10) || chr(10) || lang || chr(10) || 'Chief Complaint' || chr(10)"
    " || source || chr(10) || 'Discharge Medications:' || chr(10) || text || chr(10)"
    " || 'Brief Hospital Course:' || chr(10) || source"
)
_HEADERS = "|".join(ft.SECTION_HEADERS)
_EDGE = r"[\t\n\x0B\f\r\x{0085}\p{Z}\x{1c}-\x{1f}]+"
_STRIP = f"regexp_replace(%s, '^{_EDGE}|{_EDGE}$', '', 'g')"
_SECTIONS = rf"""
WITH n AS (SELECT doc_id, {_NOTE} AS note FROM documents),
p AS (SELECT doc_id,
  regexp_split_to_array(note, '(?im)^({_HEADERS})\s*:?\s*$') AS bodies,
  regexp_extract_all(note, '(?im)^({_HEADERS})\s*:?\s*$', 1) AS heads FROM n),
s AS (SELECT doc_id, unnest(range(0, len(heads) + 1)) AS position, heads, bodies FROM p),
rows AS (SELECT doc_id, CAST(position AS INTEGER) AS position,
  CASE WHEN position = 0 THEN 'preamble' ELSE heads[position] END AS section,
  {_STRIP % 'bodies[position + 1]'} AS body FROM s)
"""


def _with_headers(spark, d):
    docs = raw_documents(spark, d)
    return docs.withColumn("note", F.expr(_NOTE))


@query(
    "t2_section_rows",
    _SECTIONS + "SELECT doc_id, position, section, md5(body) AS digest FROM rows",
)
def t2(spark, d):
    rows = ot.section_rows(_with_headers(spark, d), "doc_id", "note")
    return rows.select("doc_id", "position", "section", F.md5("body").alias("digest"))


@query(
    "t2_section_map",
    _SECTIONS
    + """SELECT doc_id, count(DISTINCT section) AS n_sections,
         arg_max(CASE WHEN section = 'Chief Complaint' THEN body END,
                 CASE WHEN section = 'Chief Complaint' THEN position END) AS complaint
         FROM rows GROUP BY doc_id""",
)
def t2_map(spark, d):
    mapped = _with_headers(spark, d).select("doc_id", ft.section_map(F.col("note")).alias("m"))
    return mapped.select(
        "doc_id",
        F.size("m").cast("long").alias("n_sections"),
        F.element_at("m", "Chief Complaint").alias("complaint"),
    )


@query(
    "t3_remove_sections",
    rf"""WITH n AS (SELECT doc_id, {_NOTE} AS note FROM documents)
    SELECT doc_id, md5({_STRIP % (
        "regexp_replace(note, '(?ims)^Discharge Medications"
        + chr(92) + "s*:?" + chr(92) + "s*" + chr(92) + "n(.*?)(" + chr(92)
        + "n[A-Z][A-Za-z ]+" + chr(92) + "s*:?" + chr(92) + "s*" + chr(92) + "n|" + chr(92) + "z)', '"
        + chr(92) + "2')"
    )}) AS digest FROM n""",
)
def t3(spark, d):
    out = ft.remove_sections(F.col("note"), ["Discharge Medications"])
    return _with_headers(spark, d).select("doc_id", F.md5(out).alias("digest"))


@query(
    "t4_tokens",
    with_docs(
        "SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM docs"
    ),
)
def t4(spark, d):
    return documents(spark, d).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


_EXTRA = ["ing", "ment", "er", "ed", "tion"]


@query(
    "u1_stopword_union",
    with_docs(
        f"""SELECT lang, CAST(sum(len(list_filter(tokens, lambda w: w NOT IN ({sql_list(_EXTRA)}))))
            AS BIGINT) AS n_tokens FROM docs GROUP BY lang"""
    ),
)
def u1(spark, d):
    cleaned = ot.add_clean_text(raw_documents(spark, d))
    kept = ft.tokenize(F.col("cleaned_text"), _EXTRA)
    return cleaned.groupBy("lang").agg(F.sum(F.size(kept)).alias("n_tokens"))


_WORDS = """
w AS (SELECT doc_id, unnest(tokens) AS a, generate_subscripts(tokens, 1) - 1 AS pos FROM docs),
p AS (SELECT doc_id, pos, a, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w),
uni AS (SELECT a, count(*) AS n FROM w GROUP BY a),
pairs AS (SELECT a, b, count(*) AS n_ab FROM p WHERE b IS NOT NULL GROUP BY a, b),
kept AS (SELECT pairs.a, pairs.b, n_ab, x.n AS n_a, y.n AS n_b,
  (n_ab - 10) / x.n::DOUBLE / y.n::DOUBLE
    * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM pairs)) AS score,
  ln((n_ab / t.n) / ((x.n / t.n) * (y.n / t.n))) / -ln(n_ab / t.n) AS npmi
  FROM pairs JOIN uni x ON pairs.a = x.a JOIN uni y ON pairs.b = y.a,
    (SELECT count(*)::DOUBLE AS n FROM w) t WHERE n_ab >= 10)
"""


@query(
    "t5_phrase_scores",
    with_docs(f", {_WORDS} SELECT a, b, n_ab, n_a, n_b, {sql_r6('score')} AS score FROM kept"),
)
def t5(spark, d):
    docs = materialize(documents(spark, d).select("tokens"), "tokens")
    out = ot.phrase_scores(docs, 10)
    return out.withColumn("score", r6(F.col("score")))


@query(
    "t5_phrase_npmi",
    with_docs(f", {_WORDS} SELECT a, b, n_ab, {sql_r6('npmi')} AS score FROM kept"),
)
def t5_npmi(spark, d):
    docs = materialize(documents(spark, d).select("tokens"), "tokens")
    out = ot.phrase_scores(docs, 10, "npmi")
    return out.select("a", "b", "n_ab", r6(F.col("score")).alias("score"))


def _phrase_pass(of: str, number: int, threshold: float) -> str:
    """One pass over table ``of`` (doc_id, tokens), as table ``pass<number>``."""
    n = number
    return f"""
w{n} AS (SELECT doc_id, unnest(tokens) AS a, generate_subscripts(tokens, 1) - 1 AS pos FROM {of}),
p{n} AS (SELECT doc_id, pos, a, lead(a) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM w{n}),
uni{n} AS (SELECT a, count(*) AS n FROM w{n} GROUP BY a),
pairs{n} AS (SELECT a, b, count(*) AS n_ab FROM p{n} WHERE b IS NOT NULL GROUP BY a, b),
kept{n} AS (SELECT q.a, q.b FROM pairs{n} q JOIN uni{n} x ON q.a = x.a JOIN uni{n} y ON q.b = y.a
  WHERE n_ab >= 10 AND (n_ab - 10) / x.n::DOUBLE / y.n::DOUBLE
    * ((SELECT count(*) FROM uni{n}) + (SELECT count(*) FROM pairs{n})) > {threshold}),
hits{n} AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM p{n} SEMI JOIN kept{n} k ON p{n}.a = k.a AND p{n}.b = k.b),
cut{n} AS (SELECT doc_id, pos FROM (SELECT *, pos - min(pos) OVER (PARTITION BY doc_id, run) AS off
  FROM hits{n}) WHERE off % 2 = 0),
joined{n} AS (SELECT p.doc_id, p.pos, CASE WHEN c.pos IS NOT NULL THEN p.a || '_' || p.b ELSE p.a END AS t
  FROM p{n} p LEFT JOIN cut{n} c ON p.doc_id = c.doc_id AND p.pos = c.pos
  WHERE NOT EXISTS (SELECT 1 FROM cut{n} e WHERE e.doc_id = p.doc_id AND e.pos = p.pos - 1)),
pass{n} AS (SELECT o.doc_id, coalesce(j.tokens, []::VARCHAR[]) AS tokens
  FROM {of} o LEFT JOIN (SELECT doc_id, list(t ORDER BY pos) AS tokens FROM joined{n} GROUP BY doc_id) j USING (doc_id))"""


@query(
    "t5_joined_phrases",
    with_docs(
        f""", {_phrase_pass('docs', 1, 3)}, {_phrase_pass('pass1', 2, 3)}
        SELECT doc_id, len(tokens) AS n_tokens, md5(coalesce(array_to_string(tokens, ' '), '')) AS digest FROM pass2"""
    ),
)
def t5_joined(spark, d):
    docs = documents(spark, d).select("doc_id", "tokens")
    out = ot.add_phrases(docs, 10, 3.0)
    return out.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query(
    "t6_prepare_text",
    with_docs(
        f""", within AS (SELECT * FROM docs WHERE length(cleaned_text) BETWEEN 100 AND 50000),
        {_phrase_pass('within', 1, 50)}, {_phrase_pass('pass1', 2, 50)}
        SELECT doc_id, len(pass2.tokens) AS num_tokens, md5(cleaned_text) AS digest,
               md5(coalesce(array_to_string(pass2.tokens, ' '), '')) AS tokens_digest
        FROM pass2 JOIN within USING (doc_id)"""
    ),
)
def t6(spark, d):
    docs = raw_documents(spark, d)
    out = prepare_text(docs, removed_sections=ft.DEFAULT_REMOVED_SECTIONS)
    return out.select(
        "doc_id",
        F.col("num_tokens").cast("long").alias("num_tokens"),
        F.md5("cleaned_text").alias("digest"),
        F.md5(F.array_join("tokens", " ")).alias("tokens_digest"),
    )


@query(
    "a6_vocabulary",
    with_docs(
        f"""SELECT (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM docs)) AS vocabulary_size,
            {sql_r6('avg(len(tokens))')} AS avg_tokens FROM docs"""
    ),
)
def a6(spark, d):
    out = ot.vocabulary_summary(documents(spark, d).select("tokens"))
    return out.withColumn("avg_tokens", r6(F.col("avg_tokens")))


@query(
    "t7_document_term_counts",
    with_docs(
        """, tf AS (SELECT doc_id, t AS term, count(*) AS tf
              FROM (SELECT doc_id, unnest(tokens) AS t FROM docs) GROUP BY 1, 2),
           df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
           vocab AS (SELECT term FROM df WHERE df >= 5 AND df <= 0.95 * (SELECT count(*) FROM docs)
                     ORDER BY df DESC, term LIMIT 100000)
           SELECT doc_id, term, tf FROM tf SEMI JOIN vocab USING (term)"""
    ),
)
def t7(spark, d):
    docs = materialize(documents(spark, d).select("doc_id", "tokens"), "tokens")
    vocab = ot.fit_vocabulary(docs, F.col("tokens"), 5, 0.95, 100_000, rank_by="df")
    return ot.document_term_counts(docs, F.col("tokens"), vocab).select("doc_id", "term", "tf")


def sql_tfidf(weight: str) -> str:
    """Weights of uni- and bigrams over the 5000 most frequent allowed terms."""
    return rf""", terms AS (SELECT doc_id,
        regexp_extract_all(lower(array_to_string(tokens, ' ')), '[\p{{L}}\p{{N}}_]{{2,}}') AS ws FROM docs),
      g AS (SELECT doc_id, unnest(list_concat(ws,
              list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM terms),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
      df AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term),
      vocab AS (SELECT term, df FROM df
                WHERE df >= 5 AND df <= 0.95 * (SELECT count(*) FROM docs)
                ORDER BY cnt DESC, term LIMIT 5000),
      raw AS (SELECT doc_id, term, ({weight})
                * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)::DOUBLE) + 1) AS w
              FROM tf JOIN vocab USING (term)),
      unit AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def _tfidf(spark, d, sublinear):
    terms = ft.terms(F.array_join("tokens", " ")).alias("terms")
    docs = materialize(documents(spark, d).select("doc_id", terms), "terms")
    vocab = ot.fit_bigram_vocabulary(docs, F.col("terms"))
    rows = ot.tfidf_rows(docs, ft.ngrams(F.col("terms")), vocab, sublinear=sublinear)
    return rows.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query(
    "t8_tfidf_raw",
    with_docs(sql_tfidf("tf") + f" SELECT doc_id, term, {sql_r6('weight')} AS weight FROM unit"),
)
def t8(spark, d):
    return _tfidf(spark, d, False)


@query(
    "f3_tfidf_sublinear",
    with_docs(
        sql_tfidf("1 + ln(tf)") + f" SELECT doc_id, term, {sql_r6('weight')} AS weight FROM unit"
    ),
)
def f3(spark, d):
    return _tfidf(spark, d, True)


@query(
    "t9_joined_tokens",
    with_docs("SELECT doc_id, length(array_to_string(tokens, ' ')) AS n_chars FROM docs"),
)
def t9(spark, d):
    return documents(spark, d).select(
        "doc_id", F.length(F.array_join("tokens", " ")).cast("long").alias("n_chars")
    )
