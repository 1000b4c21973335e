"""Line deduplication with a log-template tree, all in native expressions.

A line's tokens are its words; a token with a digit is a variable field and reads `<*>`. The tree has a fixed
depth: the number of tokens, then the first DEPTH tokens. The leaf holds templates. An exact template is the
line after masking; it recurs if at least `min_docs` documents have it, or `long_docs` where it has LONG_WORDS or
more tokens that are no variable field: short lines repeat by chance, a long one is a passage. The lines of a leaf that don't recur
this way are generalised: a token stays if at least `min_docs` documents of the leaf have it at its position,
else it becomes a variable field; if four fifths of the tokens stay, and `min_docs` documents share the
generalised template, that recurs. Lines of recurring templates are dropped from all documents but the first
(smallest doc_id) that has the template, so nothing is lost from the corpus as a whole.

Hashes stand for templates in all shuffles; texts of lines move only for leaves with something to generalise.
Defined results: a null text has no lines and stays null; blank lines are kept and are no template; rows that
repeat in id and text count as one document and are all kept or changed alike; null ids count as the largest; very long texts and
lines are split and hashed whole; an empty table stays empty; other columns pass through, only `deduplicate` replaces columns named like its counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, written

DEPTH = 3
MIN_DOCS = 5
LONG_WORDS, LONG_DOCS = 8, 2
VARIABLE = "<*>"


def _masked(lines: DataFrame) -> DataFrame:
    """Lines `m` with white space made single and variable fields masked."""
    # nearly all lines have single blanks only, and a test costs far less than the replacement of each of them
    doubled = F.contains(F.col("m"), F.lit("  ")) | F.col("m").rlike(r"[\x09\x0B-\x0D]")
    lines = lines.withColumn("m", F.trim(F.when(doubled, F.regexp_replace("m", r"[\x20\x09\x0B-\x0D]++", " ")).otherwise(F.col("m"))))
    # most lines have no digit, and the test costs a tenth of the replacement
    return lines.withColumn("m", F.when(F.col("m").rlike("[0-9]"), F.regexp_replace("m", r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+", VARIABLE)).otherwise(F.col("m")))


def _tokens(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _hashed(df: DataFrame) -> DataFrame:
    """Add leaf and template hashes of the masked line `m` (128 bits for a template)."""
    leaf = F.xxhash64(_tokens(F.col("m")), F.substring_index("m", " ", DEPTH))
    return df.withColumn("leaf", leaf).withColumn("t", F.xxhash64("m")).withColumn("u", F.xxhash64(F.lit(7), "m"))


def _is_long(line: Column) -> Column:
    # few lines have a variable field
    variable = F.when(F.contains(line, F.lit(VARIABLE)), F.regexp_count(line, F.lit(r"(?<![^\x20])<\*>(?![^\x20])"))).otherwise(0)
    return _tokens(line) - variable >= LONG_WORDS


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add (_k, _l), equal for equal documents only, and the id that orders documents."""
    order = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))
    text = F.col(f"`{text_col}`")
    return docs.withColumn("_id", order).withColumn("_k", F.xxhash64("_id", text)).withColumn("_l", F.xxhash64(F.lit(7), text, "_id"))


def _exploded(docs: DataFrame, text_col: str) -> DataFrame:
    lines = docs.where(F.col(f"`{text_col}`").isNotNull()).select("_id", "_k", "_l", F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("no", "m"))
    # blank lines go by the raw line: the optimiser would compute a condition on the masked one a second time
    lines = _masked(lines.where(F.col("m").rlike(f"[^{SPACE_CLASS}]")))
    return _hashed(lines)


def recurring(docs: DataFrame, lines: DataFrame, text_col: str, min_docs: int, long_docs: int | None) -> DataFrame:
    """(t, u, first): the templates that recur, each with the first document that has it."""
    long = ["long"] if long_docs else []
    templates = written(lines.groupBy("leaf", "t", "u", *long, "_k", "_l").agg(F.min("_id").alias("_id")).groupBy("leaf", "t", "u", *long).agg(F.count(F.lit(1)).alias("docs"), F.min("_id").alias("first")), "templates")
    enough = F.col("docs") >= min_docs
    exact = templates.where(enough | (F.col("long") & (F.col("docs") >= long_docs)) if long_docs else enough).select("t", "u", "first")
    # leaves in which enough documents are left to share a generalised template
    leaves = written(templates.where(F.col("docs") < min_docs).groupBy("leaf").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"), "leaves")
    texts = _exploded(docs, text_col).join(leaves, "leaf", "left_semi").groupBy("leaf", "t", "u").agg(F.min("m").alias("m"))
    texts = written(texts.join(templates, ["leaf", "t", "u"]), "texts")
    tokens = texts.select("leaf", "t", "u", "docs", "first", F.posexplode(F.split("m", " ")).alias("at", "token"))
    # a document counts once for a token or a generalised template, however many of its lines have it
    holders = written(lines.select("leaf", "t", "u", "_k", "_l").join(texts.where(F.col("docs") < min_docs).select("leaf", "t", "u"), ["leaf", "t", "u"]).distinct(), "holders")
    rare = tokens.where((F.col("docs") < min_docs) & (F.col("token") != VARIABLE)).join(holders, ["leaf", "t", "u"])
    shared = rare.select("leaf", "at", "token", "_k", "_l").distinct().groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    support = tokens.where((F.col("docs") >= min_docs) & (F.col("token") != VARIABLE)).select("leaf", "at", "token").union(shared.select("leaf", "at", "token")).distinct().withColumn("support", F.lit(True))
    # the leading tokens of a leaf are in all its templates: two plain shuffles, of which adaptive execution can split hot keys
    support = written(support, "support")
    rare = tokens.where(F.col("docs") < min_docs).join(support, ["leaf", "at", "token"], "left")
    stays = F.col("support").isNotNull()
    general = rare.groupBy("leaf", "t", "u", "docs", "first").agg(
        F.sort_array(F.collect_list(F.struct("at", F.when(stays, F.col("token")).otherwise(F.lit(VARIABLE)).alias("token")))).alias("template"),
        F.count(F.lit(1)).alias("n"), F.count_if(stays | (F.col("token") == VARIABLE)).alias("same"))
    general = general.where("5 * same >= 4 * n").withColumn("g", F.xxhash64("leaf", "template")).withColumn("h", F.xxhash64(F.lit(7), "template", "leaf")).drop("template")
    groups = general.join(holders, ["leaf", "t", "u"]).groupBy("g", "h", "_k", "_l").agg(F.min("first").alias("first")).groupBy("g", "h").agg(F.count(F.lit(1)).alias("all"), F.min("first").alias("first")).where(F.col("all") >= min_docs).select("g", "h", F.col("first").alias("group_first"))
    found = exact.union(general.join(groups, ["g", "h"]).select("t", "u", "group_first"))
    # a long template may also belong to a generalised one, whose first document is the one that keeps it
    return found.groupBy("t", "u").agg(F.min("first").alias("first")) if long_docs else found


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, long_docs: int | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """`docs` with the text that is left, and two `counts`: lines with a word, and those of them that were dropped.

    Without `long_docs`, long templates need `min_docs` documents like others."""
    columns = [c for c in docs.columns if c not in counts]
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col])
    keyed = _keyed(docs.select(F.col(f"`{id_col}`").alias("_doc"), row.alias("_row"), F.col(f"`{text_col}`").alias("_text")), "_doc", "_text")
    lines = _exploded(keyed, "_text")
    lines = written((lines.withColumn("long", _is_long(F.col("m"))) if long_docs else lines).drop("m"), "lines")
    gone = written(recurring(keyed, lines, "_text", min_docs, long_docs), "recurring")
    dropped = written(lines.join(gone, ["t", "u"]).where("_id <> first").groupBy("_k", "_l").agg(F.collect_set("no").alias("_gone")), "dropped")
    out = keyed.join(dropped, ["_k", "_l"], "left")
    all_lines = F.split("_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))
    n = F.coalesce(F.size(F.filter(all_lines, lambda x: x.rlike(f"[^{SPACE_CLASS}]"))), F.lit(0)).cast("long")
    n = F.when(F.col("_text").isNull(), F.lit(0)).otherwise(n)
    parts = [text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in columns]
    return out.select(*parts, n.alias(counts[0]), F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)).cast("long").alias(counts[1]))


def keep(docs: DataFrame, min_docs: int = MIN_DOCS, long_docs: int | None = LONG_DOCS) -> DataFrame:
    """`docs` with recurring lines dropped, without the documents that have nothing left because of it."""
    n_lines, n_dropped = free_name(docs.columns, "lines"), free_name(docs.columns, "dropped")
    out = deduplicate(docs, min_docs=min_docs, long_docs=long_docs, counts=(n_lines, n_dropped))
    return out.where((F.col(n_dropped) == 0) | (F.col(n_dropped) < F.col(n_lines))).select(*[F.col(f"`{c}`") for c in docs.columns])
