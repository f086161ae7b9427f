"""Line deduplication over a corpus, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import SPACE, ascii_lower, digest_pair, text_of
from panelloom.session import stored


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(SPACE))


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_documents: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Drop lines whose key occurs in many documents, except in the largest document holding it.

    A line's key is the line with ASCII white space stripped and A-Z lower-cased. Keys of at
    least `min_chars` code points found under at least `min_documents` distinct ids lose all
    their lines outside the largest of those ids. Adds `kept_lines` (array, in the order of
    the text), `n_lines` and `n_dropped` to the document's columns.

    Null or empty text is one empty line; an empty table gives no rows. Rows with a null id
    neither count nor lose lines; rows sharing an id are one document when counting, and each
    keeps its own lines. Lines travel as digests with their positions, long lines and texts as
    well. A common line is counted by partial sums, and what meets by line are its occurrences,
    which an adaptive join may split. The positions a text loses come back to it, and it is put
    together again from the others, in time linear in its lines. Columns named like the added
    ones are replaced; others may have any name.
    """
    lines = F.split(text_of(text), "\n", -1)
    mark = F.xxhash64(F.lit("row"), text_of(text))
    # Two selects: beside the generator, the mark would be worked out from the whole text for every line of it.
    whole = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), mark.alias("mark"), lines.alias("all_lines"))
    own = whole.select("id", "mark", F.posexplode("all_lines").alias("pos", "line"))
    own = own.where(F.char_length(line_key(F.col("line"))) >= min_chars)
    held = own.select("id", "mark", "pos", *[c.alias(f"h{i}") for i, c in enumerate(digest_pair(line_key(F.col("line"))), 1)])
    # Stored, so that both sides of the next join are dealt anew and a common line's pairs can be split over tasks.
    common = stored(held.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_documents), "common-lines")
    lost = held.join(common, ["h1", "h2"]).where("id <> last").groupBy("id", "mark").agg(F.collect_set("pos").alias("lost_at"))
    given = documents.drop("kept_lines", "n_lines", "n_dropped")
    # Held in an array of one, the lines are a variable below: a text is split once, not once for each place.
    kept = F.when(lost["lost_at"].isNull(), lines).otherwise(F.get(F.transform(F.array(lines), lambda all_lines: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), lost["lost_at"]), lambda at: F.get(all_lines, at))), F.lit(0)))
    return given.join(lost, (given[key] == lost["id"]) & (mark == lost["mark"]), "left").select(
        given["*"], kept.alias("kept_lines"), F.size(lines).cast("long").alias("n_lines")
    ).withColumn("n_dropped", F.col("n_lines") - F.size("kept_lines"))


def joined(lines: str = "kept_lines") -> Column:
    return F.array_join(F.col(lines), "\n")


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS dropped
  FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
