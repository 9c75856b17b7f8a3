"""Problem 4: checking new batches against all history with an incremental inverted index.

`History` keeps, below one shared folder, what the accepted entries brought in:

* ``judged``: the entries with their exact tokens (path and signature, digest); the accepted ones are looked up;
* ``postings-V``: perceptual tokens ``g`` with the patterns of the rarest frames (the prefix) of each class, bucketed by token;
* ``holders-V``: these patterns, each once, with the class that holds it, bucketed by pattern;
* ``classes-V``: the frames of each class, stored once, bucketed by class, for verification;
* ``manifest-N``: what was complete after batch N, and the version V of the layout.

A batch is probed, matches are verified on whole frame lists, the entries without
match are accepted, and only their postings are appended.  A folder can be opened
again by another session: rows of a batch that was not completed are ignored.

Both sides use prefixes (see `frames.prefixes`); classes whose numbers of usable
frames cannot give half of all pairs are dropped by these lengths before they are
verified.  Plan and rarity come from accepted data and the batch at hand; when the
index has outgrown its plan four times, it is laid out anew with more tokens and
buckets, which costs a fixed share of what was indexed since.

A batch shuffles its own rows only: each table of the index is bucketed by all keys
by which it is joined.  Of the index it reads the narrow postings of its tokens'
buckets, the holders and, for verification, the classes.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.frames import DH_BITS, PH_BITS, classes_match, digest, frame_rows, path_frames, prefixes
from tesserae.operators.hamming import GROUP_ROWS, cross_pairs, plan_for, routed, sides
from tesserae.session import Scratch

#: A table of up to this many rows of under 100 bytes is broadcast; larger ones are shuffled.
SMALL_ROWS = 200_000
#: An index that holds this many times the patterns it was planned for is laid out anew.
OUTGROWN = 4
CID = "struct<h: bigint, i: bigint>"
JUDGED = f"batch_id int, entry_id bigint, cid {CID}, tokens array<{CID}>, repeats boolean, stored boolean, tag bigint"
#: Columns and bucket keys of the bucketed tables.
TABLES = {
    "postings": ("g int, v bigint, w bigint", ["g"]),
    "holders": ("v bigint, w bigint, h bigint, nf bigint, u int", ["v", "w"]),
    "classes": ("h bigint, cid struct<h: bigint, i: bigint>, nf bigint, fs array<struct<dh: bigint, ph: bigint, hist: array<int>, nn: double>>", ["h"]),
}


def sized(df: DataFrame, n: int) -> DataFrame:
    """``df``, broadcast if its ``n`` rows are few enough."""
    return F.broadcast(df) if n <= SMALL_ROWS else df


def pair_hash(*columns: str | Column) -> Column:
    """Two hashes of the columns, an identity of 128 bits."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(7), *columns).alias("i"))


def prepare(entries: DataFrame, frames: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables of batches to check, laid out by ``batch_id``.

    Entries ``entry_id, cid, tokens``; their classes ``cid, nf, fs``; and the prefixes of these, each batch on its own.
    """
    spark = entries.sparkSession
    e = entries.select("batch_id", "entry_id", "path", "sig", digest("md5").alias("digest")).where("batch_id is not null").distinct()
    by_sig = F.when(F.col("path").isNotNull() & (F.col("sig") != ""), pair_hash(F.lit("s"), "path", "sig"))
    by_digest = F.when(F.col("digest").isNotNull(), pair_hash(F.lit("m"), "digest"))
    paths = scratch.keep(path_frames(frame_rows(frames, e.select("path").distinct())), "paths")
    known = e.select("batch_id", "entry_id", "path", F.array_compact(F.array(by_sig, by_digest)).alias("tokens")).join(paths.select("path", "cid"), "path", "left")

    def part(df: DataFrame, name: str) -> DataFrame:
        df.write.partitionBy("batch_id").parquet(scratch.path(name))
        return spark.read.schema(df.schema).parquet(scratch.path(name))

    stored = part(known.select("entry_id", "cid", "path", "tokens", "batch_id"), "entries")
    # one path's frames for each class that a batch brings
    heads = stored.where("cid is not null").groupBy("batch_id", "cid").agg(F.min("path").alias("path"))
    classes = part(paths.drop("cid").join(heads, "path").select("cid", "nf", "fs", "batch_id"), "classes")
    return stored.drop("path"), classes, part(prefixes(classes, ("cid", "batch_id")), "prefixes")


class History:
    """The index below ``scratch``; `create` makes one, `open` continues one."""

    def __init__(self, spark: SparkSession, scratch: Scratch, state: dict):
        self.spark, self.scratch, self.state, self.names = spark, scratch, state, {}
        self._tables()

    @classmethod
    def create(cls, spark: SparkSession, scratch: Scratch, expected: int, buckets: int = 12) -> History:
        """An empty index, planned for ``expected`` patterns; more only make it be laid out anew."""
        return cls(spark, scratch, {"tags": [], "planned": max(1, expected), "patterns": 0, "version": 0, "buckets": buckets})

    @classmethod
    def open(cls, spark: SparkSession, scratch: Scratch) -> History:
        """The index of a folder as it was after its last complete batch."""
        rows = spark.read.schema("value string").text(scratch.path("manifest")).collect()
        return cls(spark, scratch, max((json.loads(r["value"]) for r in rows), key=lambda s: len(s["tags"])))

    @property
    def batches(self) -> int:
        return len(self.state["tags"])

    @property
    def plan(self):
        return plan_for(self.state["planned"], DH_BITS, index=True)

    def _tables(self) -> None:
        for name, (columns, keys) in TABLES.items():
            self.names[name] = f"t_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self.names[name]} ({columns}, tag bigint) using parquet clustered by ({', '.join(keys)}) into {self.state['buckets']} buckets location '{self._path(name)}'")

    def _path(self, name: str) -> str:
        return self.scratch.path(f"{name}-{self.state['version']}")

    def _append(self, df: DataFrame, name: str) -> None:
        # one file per bucket and batch
        df.repartition(self.state["buckets"], *TABLES[name][1]).write.insertInto(self.names[name])

    def _read(self, name: str) -> DataFrame:
        """The rows of complete batches."""
        self.spark.catalog.refreshTable(self.names[name])
        return self.spark.table(self.names[name]).where(self._complete())

    def _complete(self) -> Column:
        # an array literal, unlike a list of values, leaves the generated code the same for every batch
        return F.array_contains(F.lit(self.state["tags"]).cast("array<bigint>"), F.col("tag"))

    def judged(self) -> DataFrame:
        """The entries of all complete batches, as they were judged."""
        return self.spark.read.schema(JUDGED).parquet(self.scratch.path("judged")).where(self._complete())

    def candidates(self, probes: DataFrame, n: int) -> DataFrame:
        """``p, q``: hashes of classes of the batch and of the index with near patterns among their rarest frames, pairs may repeat.

        ``probes``: ``cid, nf, u, v, w``.
        """
        plan, width, keys = self.plan, 2 * GROUP_ROWS, ["g"]
        sent = probes.select(F.explode(routed(F.col("v"), plan, sides(plan)[0])).alias("g"), "v", "w")
        # bucketed by token: neither this nor the groups below shuffle the index
        index = self._read("postings").select("g", "v", "w").distinct()
        if self.state["patterns"] * len(plan.blocks) > width:
            # a token that very many patterns carry is cut into chunks, which meet each chunk of the probes
            count = lambda df, c: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) * 2 / width).cast("int").alias(c))
            hot = count(self._read("postings"), "ic").where("ic > 2")
            if not hot.isEmpty():
                hot = self.scratch.keep(hot.join(count(sent, "pc"), "g"), f"hot-{self.batches}")
                keys = ["g", "i", "p"]
                part = lambda c: F.pmod(F.xxhash64("v", "w"), F.coalesce(c, F.lit(1))).cast("int")
                every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
                sent = sent.join(hot, "g", "left").withColumn("p", part("pc")).withColumn("i", every("ic")).drop("ic", "pc")
                index = index.join(hot, "g", "left").withColumn("i", part("ic")).withColumn("p", every("pc")).drop("ic", "pc")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("g", "v1", "w1", "v2", "w2")})
            a, g = a[["v", "w"]].drop_duplicates(), int(a["g"].iloc[0])
            av, aw, bv, bw = (d[c].to_numpy() for d in (a, b) for c in ("v", "w"))
            i, j = cross_pairs(av.view("uint64"), bv.view("uint64"), g, plan, (aw.view("uint64"), bw.view("uint64"), PH_BITS))
            return pd.DataFrame({"g": g, "v1": av[i], "w1": aw[i], "v2": bv[j], "w2": bw[j]})

        if keys == ["g"]:
            sent = sent.repartition(self.state["buckets"], "g")
        met = sent.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(meet, "g int, v1 bigint, w1 bigint, v2 bigint, w2 bigint")
        # classes join by pattern, so a pattern that many of them share is never gathered; the holders lie by pattern and stay where they are
        met = self.scratch.keep(met, f"met-{self.batches}")
        held = self._read("holders").select(F.col("v").alias("v2"), F.col("w").alias("w2"), F.col("h").alias("q"), F.col("nf").alias("nf2"), F.col("u").alias("u2"))
        own = sized(probes.select(F.col("v").alias("v1"), F.col("w").alias("w1"), F.col("cid.h").alias("p"), "nf", "u"), n)
        return held.join(met.drop("g"), ["v2", "w2"]).join(own, ["v1", "w1"]).where("2 * u * u2 >= nf * nf2").select("p", "q")

    def judged_classes(self, classes: DataFrame, probes: DataFrame, n: int) -> DataFrame:
        """``cid, similar, stored`` of the classes ``cid, nf, fs`` (``n`` frames) with candidates: whether one matches, whether one is the class itself."""
        # hashes only lead to the classes; the frames themselves decide
        b = self._read("classes").select(F.col("h").alias("q"), F.col("cid").alias("q_cid"), F.col("nf").alias("b_nf"), F.col("fs").alias("b_fs"))
        a = sized(classes.select(F.col("cid.h").alias("p"), "cid", F.col("nf").alias("a_nf"), F.col("fs").alias("a_fs")), n)
        full = b.join(self.candidates(probes, n), "q").join(a, "p")
        return full.groupBy("cid").agg(F.max(classes_match("a_", "b_")).alias("similar"), F.max(F.col("cid") == F.col("q_cid")).alias("stored"))

    def check_prepared(self, batch: int, now: DataFrame, classes: DataFrame, prefix: DataFrame, n: int, frames: int) -> None:
        """Judge and accept the ``n`` entries of a batch with ``frames`` usable frames, given as `prepare` makes them."""
        # a number of its own, so that rows of an attempt that was not completed never count
        tag = uuid.uuid4().int >> 66
        judged = now.withColumn("repeats", F.lit(False)).withColumn("stored", F.lit(False))
        if self.batches:
            tokens = now.select("entry_id", F.explode("tokens").alias("token"))
            held = self.judged().where("not repeats").select(F.explode("tokens").alias("token"))
            hits = held.join(sized(tokens, 2 * n), "token").select("entry_id").distinct().withColumn("exact", F.lit(True))
            judged = now.join(sized(hits, n), "entry_id", "left").join(sized(self.judged_classes(classes, prefix, frames), n), "cid", "left")
            repeats = F.coalesce("exact", F.lit(False)) | F.coalesce("similar", F.lit(False))
            judged = judged.select(*now.columns, repeats.alias("repeats"), F.coalesce("stored", F.lit(False)).alias("stored"))
        judged = judged.select(F.lit(batch).cast("int").alias("batch_id"), "entry_id", "cid", "tokens", "repeats", "stored", F.lit(tag).cast("bigint").alias("tag"))
        self.scratch.append(judged, "judged")
        new = self.spark.read.schema(JUDGED).parquet(self.scratch.path("judged")).where(F.col("tag") == tag)
        new = sized(new.where("not repeats and not stored and cid is not null").select("cid"), n)
        fresh = lambda df: df.join(new, "cid", "left_semi").withColumn("tag", F.lit(tag).cast("bigint"))
        self._append(fresh(prefix).select("v", "w", F.col("cid.h").alias("h"), "nf", "u", "tag"), "holders")
        accepted = self.spark.read.schema(self.spark.table(self.names["holders"]).schema).parquet(self._path("holders")).where(F.col("tag") == tag)
        self._append(self._routes(accepted), "postings")
        # a class that can match none has no postings, no probe will ask for it
        able = (F.floor(F.col("nf") / F.sqrt(F.lit(2.0))) + 1 - F.col("nf") + F.size("fs") > 0) & (2 * F.size("fs") >= F.col("nf"))
        self._append(fresh(classes.where(able)).select(F.col("cid.h").alias("h"), "cid", "nf", "fs", "tag"), "classes")
        self.state = self.state | {"tags": [*self.state["tags"], tag]}
        self.state["patterns"] += accepted.count()
        if self.state["patterns"] > OUTGROWN * self.state["planned"]:
            self._lay_out_anew()
        self._manifest(json.dumps(self.state))
        # lets the context cleaner drop the shuffles and broadcasts of this batch, on the driver and the executors
        self.spark.sparkContext._jvm.System.gc()

    def _lay_out_anew(self) -> None:
        old, blocks, total = {name: self._read(name) for name in TABLES}, self.plan.blocks, self.state["patterns"]
        buckets = max(self.state["buckets"], -(-total * len(blocks) // GROUP_ROWS))
        self.state = self.state | {"planned": total, "version": self.state["version"] + 1, "buckets": buckets}
        self._tables()
        for name in ("classes", "holders"):
            self._append(old[name], name)
        self._append(self._routes(old["holders"]), "postings")

    def _routes(self, patterns: DataFrame) -> DataFrame:
        groups = F.explode(routed(F.col("v"), self.plan, sides(self.plan)[1]))
        return patterns.select(groups.alias("g"), "v", "w", "tag")

    def _manifest(self, text: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        path, done = (jvm.org.apache.hadoop.fs.Path(f"{self.scratch.path('manifest')}/{mark}{self.batches:06}") for mark in ("_", "m"))
        fs = path.getFileSystem(conf)
        out = fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(path, done)

    def check(self, entries: DataFrame, frames: DataFrame) -> DataFrame:
        """``entry_id, repeats`` of the entries ``entry_id, path, sig, md5`` of one batch; those that don't repeat are accepted.

        Cases as in `repeated_entries`.  ``frames`` may hold more paths than the batch's.
        """
        inputs = Scratch(self.spark, "batch")
        parts = [df.drop("batch_id") for df in prepare(entries.withColumn("batch_id", F.lit(self.batches)), frames, inputs)]
        self.check_prepared(self.batches, *parts, parts[0].count(), parts[1].agg(F.coalesce(F.sum(F.size("fs")), F.lit(0))).first()[0])
        return self.judged().where(F.col("tag") == self.state["tags"][-1]).select("entry_id", "repeats")

    def close(self) -> None:
        """Forget the tables of this session; the folder stays."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")


def repeated_entries(cache: DataFrame, frames: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``batch_id, entry_id`` of the entries that repeat an accepted entry of a smaller batch.

    Batches are taken in order of ``batch_id``.  An entry repeats another with the
    same path and the same usable ``sig`` (neither null nor empty), the same
    digest, or a matching path.  Repeated rows count once; entries without batch
    are dropped; a null path, sig or digest only lacks that link.
    """
    spark = cache.sparkSession
    entries, classes, prefix = prepare(cache, frames, scratch or Scratch(spark, "history"))
    batches = {r["batch_id"]: r["count"] for r in entries.groupBy("batch_id").count().collect()}
    if not batches:
        return spark.createDataFrame([], "batch_id int, entry_id bigint")
    order = sorted(batches)
    of = lambda df, batch: df.where(F.col("batch_id") == batch).drop("batch_id")
    counts = {r["batch_id"]: r["n"] for r in classes.groupBy("batch_id").agg(F.sum(F.size("fs")).alias("n")).collect()}
    history = History.create(spark, Scratch(spark, "index"), 4 * counts.get(order[0], 0))
    for batch in order:
        history.check_prepared(batch, of(entries, batch), of(classes, batch), of(prefix, batch), batches[batch], counts.get(batch, 0))
    history.close()
    return history.judged().where("repeats").select("batch_id", "entry_id")
