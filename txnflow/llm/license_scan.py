"""License scans with a positional index of rare words (DataFrame functions only).

Templates are word sequences with a mandatory key phrase, a part of them that must stand word for word.  They are a table
of postings (template, word, offset), and the words' IDF a column of it, counted over all documents for the templates'
words alone.  The index is entered by each template's rarest key word, its anchor: the words of a file are joined with
the anchors, and a word at place p that is one proposes that the template begins at p minus the anchor's offset.  The
template's postings are intersected with the file at that relative position, which gives the share of the template's IDF
that is there, and the key phrase is verified in place.  Every occurrence of a key phrase holds its anchor, so none is
missed.

Templates are data: the plan does not grow with them, and they are sent to all tasks only as long as they have at most
``MOST_POSTINGS`` words in all.  Words of documents are not shuffled, only what is found, and no Python runs on them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnflow.llm.tables import written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212a"              # the one character that ``lower`` turns into an ASCII letter
MOST_POSTINGS = 1_000_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str                  # lower-case words
    key: str | None = None     # a part of the text; None: all of it
    base: bool = False         # its places are counted

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_range(self) -> tuple[int, int]:
        key = (self.key or self.text).split()
        at = next(i for i in range(len(self.words)) if self.words[i:i + len(key)] == key)
        return at, at + len(key)


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; null has none.

    ``lower`` changes more than A-Z, but never whether a character belongs to a word, and no word it changes becomes an
    ASCII one once the Kelvin sign is out of its way.  Only the first and last part of the split can be empty.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\u00e5"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def template_index(docs: DataFrame, templates: list[Template], text_col: str = "text") -> DataFrame:
    """One row a template: number, label, base, first and end of its key, words, their IDF, anchor and its offset.

    IDF is ln((1 + documents) / (1 + documents with the word)) + 1.
    """
    spark = docs.sparkSession
    if sum(len(t.words) for t in templates) > MOST_POSTINGS:
        raise ValueError(f"templates of more than {MOST_POSTINGS} words")
    rows = [(i, t.label, t.base, *t.key_range, t.words) for i, t in enumerate(templates)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, lo int, hi int, words array<string>")
    postings = table.select("template", "lo", "hi", F.posexplode("words").alias("offset", "word"))
    vocabulary = F.broadcast(postings.select("word").distinct())
    seen = docs.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("word")).join(vocabulary, "word").groupBy("word").count()
    total = docs.count()
    known = postings.join(seen, "word", "left").withColumn("idf", F.log((1.0 + total) / (1.0 + F.coalesce("count", F.lit(0)))) + 1.0)
    known = written(known.select("template", "lo", "hi", "offset", "word", "idf"), "postings")
    rarest = Window.partitionBy("template").orderBy(F.desc("idf"), "offset")
    anchors = known.where("offset >= lo AND offset < hi").withColumn("place", F.row_number().over(rarest)).where("place = 1") \
        .select("template", F.col("word").alias("anchor"), F.col("offset").alias("anchor_at"))
    weights = known.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("offset", "idf"))).alias("w"))
    return written(table.join(anchors, "template").join(weights, "template").withColumn("idf", F.transform("w", lambda x: x["idf"])).drop("w"),
                   "templates")


def found_places(docs: DataFrame, index: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, template, label, base, at, share, key): where an anchor of each distinct text proposes a template.

    ``at``: the first word of the key; ``share``: of the template's IDF that is there, 1 only if all of it is; ``key``: the key
    phrase is there.  ``digest`` is the text's SHA-256.
    """
    words = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("__text"), words_of(F.col(text_col)).alias("__words"))
    places = words.select("__text", "__words", F.posexplode("__words").alias("__p", "anchor"))
    hits = places.join(F.broadcast(index), "anchor").withColumn("start", F.col("__p") - F.col("anchor_at"))
    at = lambda i: F.when(F.col("start") + i >= 0, F.get("__words", F.col("start") + i))
    same = F.transform("words", lambda w, i: F.coalesce(at(i) == w, F.lit(False)))
    hits = hits.withColumn("same", same)
    zero = F.lit(0.0)
    part = F.aggregate(F.zip_with("same", "idf", lambda s, x: F.when(s, x).otherwise(zero)), zero, lambda acc, x: acc + x) \
        / F.aggregate("idf", zero, lambda acc, x: acc + x)
    share = F.when(F.forall("same", lambda s: s), 1.0).otherwise(F.least(part, F.lit(1.0)))
    key = F.forall(F.slice("same", F.col("lo") + 1, F.col("hi") - F.col("lo")), lambda s: s)
    # A copied text proposes the same places again.
    return hits.select(F.unhex(F.sha2("__text", 256)).alias("digest"), "template", "label", "base", (F.col("start") + F.col("lo")).cast("long").alias("at"),
                       share.alias("share"), key.alias("key")).distinct()


def scan_licenses(docs: DataFrame, templates: list[Template], text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word (long), base_labels, labels (string), score (double).

    n_base: places of the base templates' key phrases, first_word and last_word the smallest and largest word they
    start at (from 0; null without any).  base_labels and labels: the labels of base, and of all, templates whose key
    phrase occurs, distinct, sorted, joined by commas (empty if none).  score: the largest share of a template's IDF found
    at one place, 1 for a whole template, 0 for a document without any anchor.  Null and empty texts have no words
    and score 0.  All rows return, in any number; a column that has the name of a new one gives way.
    """
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    own = [c for c in docs.columns if c not in names or c == text_col]
    found = found_places(docs, template_index(docs, templates, text_col), text_col)
    base = F.col("key") & F.col("base")
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    by_text = found.groupBy(F.col("digest").alias("__digest")).agg(
        F.count_if(base).alias("__n"), F.min(F.when(base, F.col("at"))).alias("__first"), F.max(F.when(base, F.col("at"))).alias("__last"),
        joined(base).alias("__base"), joined(F.col("key")).alias("__labels"), F.max("share").alias("__score"))
    out = docs.select(*own, F.size(words_of(F.col(text_col))).cast("long").alias("n_words"), F.unhex(F.sha2(text_col, 256)).alias("__digest")) \
        .join(by_text, "__digest", "left")
    none = F.lit("")
    return out.select(*own, "n_words", F.coalesce("__n", F.lit(0)).cast("long").alias("n_base"), F.col("__first").alias("first_word"),
                      F.col("__last").alias("last_word"), F.coalesce("__base", none).alias("base_labels"),
                      F.coalesce("__labels", none).alias("labels"), F.coalesce("__score", F.lit(0.0)).alias("score"))
