"""Lines of texts, literal search and ranked full-text search."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.session import hinted, materialize

#: What ends a line: the separators of Python's splitlines.
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"
#: Weights of the ranking: saturation of term counts, and by how much long documents are discounted.
K1, B = 1.2, 0.75


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no (from 1) and line. A last, empty line is none, but an empty text has one; null has none."""
    ended = F.regexp_replace(text, f"(?:{LINE_END})\\z", "")
    return texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(ended, LINE_END)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def line_range(texts: DataFrame, key: str, text: str, start: int, limit: int) -> DataFrame:
    """Lines start to start + limit - 1 of each text, with next_start (null where the text ends)."""
    if start < 1 or not 1 <= limit <= 500:
        raise ValueError("start must be at least 1 and limit from 1 to 500")
    got = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)
    more = F.when(F.size(got) >= start + limit, F.lit(start + limit))
    cut = texts.where(F.col(text).isNotNull()).select(key, F.slice(got, start, limit).alias("_l"), more.alias("next_start"))
    return cut.select(key, "next_start", F.posexplode("_l").alias("_p", "line")).select(key, (F.col("_p") + start).alias("line_no"), "line", "next_start")


def grep(texts: DataFrame, key: str, text: str, needle: str, cut: int = 2000) -> DataFrame:
    """Lines that contain needle, whatever the case: key, line_no, line (its first `cut` characters). Texts without it are
    left out before they are cut into lines."""
    if not needle:
        raise ValueError("needle must not be empty")
    hits = lines(texts.where(F.lower(text).contains(needle.lower())), key, text).where(F.lower("line").contains(needle.lower()))
    return hits.select(key, "line_no", F.substring("line", 1, cut).alias("line"))


def terms(text: Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def index(documents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The inverted index: key, term, tf, length (terms of the document over all fields). Null fields have no terms."""
    all_ = terms(F.concat_ws(" ", *fields))
    return documents.select(key, all_.alias("_t"), F.size(all_).alias("length")).select(key, "length", F.explode("_t").alias("term")).groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def _occurrences(array: str, term: str) -> Column:
    return F.size(F.filter(array, lambda x: x == term))


def _idf(total: Column, df: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def _part(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _wanted(query: str) -> list[str]:
    found = sorted(set(query.lower().split()))
    if not found:
        raise ValueError("query must not be empty")
    return found


def _best(scored: DataFrame, key: str, k: int | None) -> DataFrame:
    return scored if k is None else scored.orderBy(F.desc(F.round("score", 9)), key).limit(k)


def search(documents: DataFrame, key: str, fields: list[str], query: str, k: int | None = 50) -> DataFrame:
    """Documents that hold every term of query, by BM25 score: key, score; the best k, ties (to 9 digits) by key (all if k
    is None).

    One pass: the corpus's size and mean length and the terms' document counts are observed while the hits are written.
    For many queries on the same documents, build a TextIndex.
    """
    wanted = _wanted(query)
    every = terms(F.concat_ws(" ", *fields))
    counts = F.array(*[_occurrences("_t", t) for t in wanted])
    sized = documents.select(key, every.alias("_t")).select(key, F.size("_t").alias("length"), counts.alias("tfs"))
    seen = Observation()
    marks = [F.sum((F.col("tfs")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))]
    watched = sized.observe(seen, F.count(F.lit(1)).alias("total"), F.sum(F.col("length").cast("long")).alias("words"), *marks)
    hits = materialize(watched.where(F.forall("tfs", lambda x: x > 0)))
    got = seen.get
    total = F.lit(float(got["total"]))
    mean = F.lit(float(got["words"] or 0) / (got["total"] or 1) or math.inf)
    score = sum((_idf(total, F.lit(float(got[f"df{i}"] or 0))) * _part(F.col("tfs")[i], F.col("length"), mean) for i in range(len(wanted))), F.lit(0.0))
    return _best(hits.select(key, score.alias("score")), key, k)


@dataclass
class TextIndex:
    """A written inverted index of documents: postings (term, key, tf, length), sorted by term so that a query's filter on
    terms reads little, and lengths (key, length), one row per document."""

    key: str
    fields: list[str]
    postings: DataFrame
    lengths: DataFrame

    @classmethod
    def build(cls, documents: DataFrame, key: str, fields: list[str]) -> TextIndex:
        postings = index(documents, key, fields).select("term", key, "tf", "length")
        lengths = documents.select(key, F.size(terms(F.concat_ws(" ", *fields))).alias("length"))
        return cls(key, fields, materialize(postings.repartitionByRange("term", key).sortWithinPartitions("term", key)), materialize(lengths))

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> TextIndex:
        """The index with the documents of changed in place of those of the same key, and without the keys of gone."""
        new = TextIndex.build(changed, self.key, self.fields)
        away = new.lengths.select(self.key) if gone is None else new.lengths.select(self.key).unionByName(gone.select(self.key))
        away = materialize(away.distinct())
        kept = self.postings.join(hinted(away), self.key, "left_anti").select("term", self.key, "tf", "length").unionByName(new.postings)
        kept = kept.repartitionByRange("term", self.key).sortWithinPartitions("term", self.key)
        left = self.lengths.join(hinted(away), self.key, "left_anti").unionByName(new.lengths)
        return TextIndex(self.key, self.fields, materialize(kept), materialize(left))

    def differs(self, documents: DataFrame) -> DataFrame:
        """Rows of postings that the index has and should not (`extra`) or should have and has not (`missing`): difference,
        term, key, tf, length. None if it is what documents give."""
        right = index(documents, self.key, self.fields).select(*self.postings.columns)
        apart = lambda a, b, name: a.exceptAll(b).select(F.lit(name).alias("difference"), "*")
        return apart(self.postings, right, "extra").unionByName(apart(right, self.postings, "missing"))

    def search(self, query: str, k: int | None = 50) -> DataFrame:
        """As search(), from the postings of the query's terms."""
        wanted = _wanted(query)
        total, mean = self.lengths.agg(F.count("*"), F.avg("length")).first()
        posts = materialize(self.postings.where(F.col("term").isin(wanted)))
        df = posts.groupBy("term").agg(F.count("*").alias("df"))  # a row per term of the query
        part = _idf(F.lit(float(total)), F.col("df")) * _part(F.col("tf"), F.col("length"), F.lit(float(mean or math.inf)))
        scored = posts.join(F.broadcast(df), "term").groupBy(self.key).agg(F.sum(part).alias("score"), F.count("*").alias("_n"))
        return _best(scored.where(F.col("_n") == len(wanted)).select(self.key, "score"), self.key, k)
