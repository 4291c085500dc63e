"""Line deduplication by a log-template tree, with DataFrame operations only.

A line's digits are masked; its leaf in the tree is its number of tokens and its first `depth` tokens. Within a leaf
that holds several forms, a position is constant where one token has at least half of the documents, else variable;
forms that agree with the constants in at least `similarity` of all positions share the leaf's template, and every
other form is a template of its own. Lines whose template occurs in at least `min_docs` documents are dropped: in all of
them, or with keep_first in all but one, so that in front of a stage that keeps one of each group of near copies, what only
copies share is not lost.

Documents with equal texts count as one, so a copied document does not make its lines recurring; repeated rows are copies.
Blank lines stay where they are. Null texts stay null, empty texts have no lines. A form that ties for a position's majority is
settled by token order. Very long lines and texts need no special care: only hashes and line numbers are shuffled, and
a document's text once. An empty table gives an empty result. Columns named n_lines and n_dropped are replaced by drop_lines()
and kept by filtered(); others stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import spill


@dataclass(frozen=True)
class Settings:
    depth: int = 4
    similarity: float = 0.6
    min_docs: int = 3
    #: Whether a recurring line stays in one document.
    keep_first: bool = False


BLANK = r"^\s*$"


def _lines(docs: DataFrame, text: str, s: Settings) -> DataFrame:
    each = docs.select(F.xxhash64(text).alias("key"), F.length(text).alias("size"), F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    each = each.filter(~F.col("content").rlike(BLANK))
    masked = F.when(F.col("content").rlike("[0-9]"), F.regexp_replace("content", "[0-9]+", "0")).otherwise(F.col("content"))
    tokens = F.split(F.btrim(masked, F.lit(" \t\r\x0b\x0c")), r"\s+")
    each = each.withColumn("tokens", tokens).withColumn("n", F.size("tokens"))
    lead = F.array_join(F.slice("tokens", 1, s.depth), " ")
    return each.withColumn("leaf", F.xxhash64("n", lead)).drop("content")


def _form() -> Column:
    return F.xxhash64("n", F.array_join("tokens", " "))


def recurring(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, forms): lines of all documents as key and size (of the text), line, form; forms that recur, with the key of the text that may keep them."""
    lines = spill(_lines(docs, text, s).select("key", "size", "line", "leaf", _form().alias("form"), "n"), "lines")
    forms = lines.select("key", "leaf", "form", "n").distinct().groupBy("leaf", "form", "n").agg(F.count("*").alias("docs"), F.min("key").alias("first"))
    forms = spill(forms, "line-forms")
    leaves = forms.filter(F.col("n") > s.depth).groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("forms"))
    mixed = spill(leaves.filter((F.col("docs") >= s.min_docs) & (F.col("forms") > 1)).select("leaf"), "line-leaves")
    # the tokens of forms in mixed leaves, one line of each
    known = _lines(docs, text, s).filter(F.col("n") > s.depth).select("leaf", "n", "tokens").join(mixed, "leaf").withColumn("form", _form())
    known = spill(known.groupBy("form").agg(F.first("leaf").alias("leaf"), F.first("tokens").alias("tokens")), "line-tokens")
    weighed = known.join(forms.select("form", "docs"), "form")
    votes = weighed.select("leaf", "docs", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("docs"))
    best = votes.groupBy("leaf", "at").agg(F.max(F.struct("docs", "token")).alias("most"), F.sum("docs").alias("all"))
    constant = F.when(F.col("most.docs") * 2 >= F.col("all"), F.col("most.token"))
    masks = spill(best.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", constant.alias("token")))), lambda x: x["token"]).alias("mask")), "line-masks")
    same: Column = F.size(F.filter(F.zip_with("tokens", "mask", lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    joined = known.join(masks, "leaf").filter(same >= s.similarity * F.size("tokens")).select("form", F.col("leaf").alias("template"))
    joined = spill(joined, "line-joined")
    shared = lines.select("key", "form").join(joined, "form").select("key", "template").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min("key").alias("first"))
    shared = spill(shared.filter(F.col("docs") >= s.min_docs), "line-shared")
    general = joined.join(shared, "template").select("form", "first")
    own = forms.filter(F.col("docs") >= s.min_docs).select("form", "first").join(joined, "form", "left_anti")
    return lines, spill(general.union(own), "line-recurring")


def drop_lines(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs without recurring lines; adds n_lines and n_dropped (ints), replacing columns of these names."""
    docs = docs.drop("n_lines", "n_dropped")
    lines, forms = recurring(docs, s, text)
    gone = lines.join(forms, "form")
    if s.keep_first:
        gone = gone.filter("key <> first")
    gone = gone.groupBy("key", "size").agg(F.collect_set("line").alias("gone"))
    gone = spill(gone.select(F.col("key").alias("_nf_id"), F.col("size").alias("_nf_size"), F.col("gone").alias("_nf_gone")), "line-gone")
    rows = docs.withColumn("_nf_key", F.xxhash64(text))
    # both sides grow with the documents, so this is a merge join at every size
    rows = rows.join(gone.hint("merge"), (F.col("_nf_key") == F.col("_nf_id")) & (F.length(text) == F.col("_nf_size")), "left").withColumn("_nf_lines", F.split(text, "\n", -1))
    rows = rows.withColumn("_nf_stay", F.array_except(F.sequence(F.lit(0), F.size("_nf_lines") - 1), "_nf_gone"))
    kept = F.array_join(F.transform("_nf_stay", lambda i: F.element_at("_nf_lines", i + 1)), "\n")
    whole = F.col("_nf_gone").isNull()
    return rows.select(
        *[F.when(whole, F.col(text)).otherwise(kept).alias(text) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_nf_lines")).alias("n_lines"), F.when(whole, 0).otherwise(F.size("_nf_gone")).alias("n_dropped"),
    )


def filtered(docs: DataFrame, s: Settings = Settings(), text: str = "text") -> DataFrame:
    """The columns of docs: recurring lines are gone, and so are documents that lost all they had. n_chars, if there, follows."""
    named = docs.withColumnsRenamed({c: f"_nf_{c}" for c in docs.columns if c in ("n_lines", "n_dropped")})
    rows = drop_lines(named, s, text).filter((F.col("n_dropped") == 0) | ~F.col(text).rlike(r"^\s*$"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*named.columns).toDF(*docs.columns)
