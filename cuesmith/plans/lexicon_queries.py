"""Queries with lexicons from tables: every word of the parts' names and of the
benchmark's passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexicon
from .registry import query, table

RULES = [(r"[?？]$", "ask", "question"), (r"\.$", "c1", "full stop")]


def words(spark, sf_dir):
    """(category, word, ord): the parts' words by brand, the passages' words of 4 letters or more by their first letter."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.expr("p_partkey % 7")).alias("category"), F.explode(F.split("p_name", " ")).alias("word"))
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("c"), F.expr("item_id % 7")).alias("category"), F.explode(F.split(F.regexp_replace("text", r"[^a-z]+", " "), " ")).alias("word"))
    both = p.unionByName(b).where("length(word) >= 4").distinct()
    return both.select("category", "word", (F.ascii("word") * 1000 + F.length("word") * 10 + F.substring("category", 2, 1).cast("int")).cast("long").alias("ord"))


_LEX = r"""lex AS (SELECT DISTINCT category, word, CAST(ascii(word) * 1000 + length(word) * 10 + CAST(substr(category, 2, 1) AS INTEGER) AS BIGINT) AS ord FROM (
  SELECT 'c' || (p_partkey % 7) AS category, unnest(string_split(p_name, ' ')) AS word FROM part
  UNION ALL SELECT 'c' || (item_id % 7), unnest(string_split(regexp_replace(text, '[^a-z]+', ' ', 'g'), ' ')) FROM benchmark) WHERE length(word) >= 4)"""
#: Every run of four characters that starts a word, then the rest of the word.
_PLACES = """ch AS (SELECT {id}, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM {table}),
g AS (SELECT {id}, i, c || lead(c, 1) OVER p || lead(c, 2) OVER p || lead(c, 3) OVER p AS g FROM ch WINDOW p AS (PARTITION BY {id} ORDER BY i)),
heads AS (SELECT DISTINCT substr(word, 1, 4) AS g FROM lex),
near AS (SELECT {id}, i, g FROM g JOIN heads USING (g)),
places AS (SELECT near.{id}, i - 1 AS position, category, word, ord FROM near JOIN lex ON near.g = substr(word, 1, 4) JOIN {table} t ON t.{id} = near.{id} AND substr(t.text, CAST(i AS INTEGER), length(word)) = word)"""


@query("x04_lexicon_places", f"WITH {_LEX}, {_PLACES.format(id='doc_id', table='documents')} SELECT doc_id, category, word, CAST(position AS INTEGER) AS position FROM places")
def lexicon_places(spark, sf_dir):
    found = lexicon.with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", words(spark, sf_dir))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.category", "h.word", "h.position")


@query("x01_lexicon_labels", f"""WITH {_LEX}, {_PLACES.format(id='doc_id', table='documents')},
h AS (SELECT DISTINCT doc_id, category, word, ord FROM places), r AS (SELECT doc_id, 'ask' AS category, 'question' AS word, 4611686018427387904 AS ord FROM documents WHERE regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[?？]$')
  UNION ALL SELECT doc_id, 'c1', 'full stop', 4611686018427387905 FROM documents WHERE regexp_matches(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\\.$')),
u AS (SELECT * FROM h UNION ALL SELECT * FROM r),
s AS (SELECT doc_id, category, CAST(sum(CASE WHEN ord >= 4611686018427387904 THEN 0.8 ELSE 1 END) AS DOUBLE) AS score, min(ord) AS first, array_to_string(list(word ORDER BY ord, word)[1:4], '、') AS basis FROM u GROUP BY doc_id, category),
k AS (SELECT *, sum(score) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first, category DESC) AS k FROM s),
o AS (SELECT trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, max('c' || (doc_id % 5)) AS fixed FROM documents WHERE doc_id % 50 = 7 GROUP BY ALL)
SELECT d.doc_id, coalesce(fixed, category, 'neutral') AS label, CASE WHEN fixed IS NOT NULL THEN 1.0::DOUBLE WHEN k.doc_id IS NULL THEN 0.0::DOUBLE ELSE round_even(score / total, 2) END AS confidence, CASE WHEN fixed IS NOT NULL THEN 'override' ELSE coalesce(basis, 'none') END AS basis
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id AND k.k = 1 LEFT JOIN o ON o.t = trim(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))""".replace("\\\\.", "\\."))
def lexicon_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fixed = docs.where("doc_id % 50 = 7").select("text", F.concat(F.lit("c"), F.expr("doc_id % 5")).alias("category"))
    return lexicon.labelled(docs, "text", words(spark, sf_dir), RULES, fixed).drop("text")


@query("x29_lexicon_first_hits", f"WITH {_LEX}, low AS (SELECT doc_id, lower(text) AS text FROM documents), {_PLACES.format(id='doc_id', table='low')}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position, ord, word) AS k FROM places) SELECT doc_id, CAST(position AS INTEGER) AS \"at\", word AS term FROM k WHERE k = 1")
def lexicon_first_hits(spark, sf_dir):
    return lexicon.first_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", words(spark, sf_dir)).drop("text")
