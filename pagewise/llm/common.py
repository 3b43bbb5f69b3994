"""What the operators of this subpackage share: words, hashes, scratch tables, packed arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
U = np.uint64


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of words; a null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), GAP), lambda w: w != "")


def set_aside(df: DataFrame, added) -> tuple[DataFrame, dict[str, str]]:
    """df with columns that are named like one of `added` (in any case) renamed to `<name>_given`, and
    the new names by the old ones."""
    taken, names = {c.lower() for c in (*df.columns, *added)}, {}
    for c in df.columns:
        if c.lower() in {a.lower() for a in added}:
            names[c] = f"{c}_given"
            while names[c].lower() in taken:
                names[c] += "_"
            taken.add(names[c].lower())
    return df.withColumnsRenamed(names), names


def unused_name(df: DataFrame, name: str) -> str:
    """name, or one like it that df has no column of."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def column(name: str) -> Column:
    """A column by its literal name."""
    return F.col(f"`{name.replace('`', '``')}`")


def sampled(docs: DataFrame, n: int) -> DataFrame:
    """n rows (doc_id, text) at most, spread by a hash: the same ones in every run.

    Rows are screened by their hash first, so that about 2 n of them are sorted, however many there are.
    """
    of = F.xxhash64("doc_id", "text")
    share = max(1, docs.count() // (2 * n))
    return docs.select("doc_id", "text").filter(F.pmod(of, F.lit(share)) == 0).orderBy(of, "doc_id", "text").limit(n)


# ---------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it names none, a folder
    of this machine's will do only if there is no other machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pagewise-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/pagewise-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagewise_path = path
    return out


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that stored() wrote and nothing reads any more."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._pagewise_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Buckets up to which numbers are looked for that hash to a bucket each; more even out by themselves.
OWN_BUCKETS = 1 << 14


def _own_bucket(spark: SparkSession, k: Column, n: int) -> Column:
    """For k from 0 to n - 1, numbers that a partitioning by hash into n sends to n different places."""
    if n > OWN_BUCKETS:
        return k
    of = spark.range(40 * n + 200).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("place")).agg(F.min("id").alias("id"))
    found = dict(of.collect())
    numbers = [found.get(place, place) for place in range(n)]
    return F.element_at(F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>"), k + 1)


def chunked(spark: SparkSession, docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Deal (doc_id, text) into chunks of about chunk_bytes of text by a hash of doc_id, or of the text
    where that is null.

    Returns a table bucketed by `chunk`, so that grouping by chunk needs no further shuffle of
    text however often it is read, and the number of chunks. Rows with equal doc_id share a chunk.
    Chunks are numbered so that each has a bucket, and so a task, of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // chunk_bytes))
    name = f"pagewise_chunks_{uuid.uuid4().hex}"
    spread = F.coalesce("doc_id", F.xxhash64("text"))
    dealt = docs.withColumn("chunk", _own_bucket(spark, F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"), n))
    dealt.repartition(n, "chunk").write.option("compression", "zstd").bucketBy(n, "chunk").saveAsTable(name)
    return spark.table(name), n


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, byte planes apart, which suits sorted keys."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zlib.compress(b"".join(parts), 1)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8)
    sizes = [np.dtype(t).itemsize for t in dtypes]
    n, at, out = len(raw) // sum(sizes), 0, []
    for t, s in zip(dtypes, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(t).reshape(n))
        at += n * s
    return out


def pack_keys(sorted_keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """As pack, with the first array, sorted uint64, as differences."""
    return pack(np.diff(sorted_keys, prepend=U(0)), *arrays)


def unpack_keys(blob: bytes, *dtypes) -> list[np.ndarray]:
    out = unpack(blob, np.uint64, *dtypes)
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def byte_texts(column) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.large_binary()).to_pylist()


# ---------------------------------------------------------------- hashes


class WordHashes(dict):
    """64-bit hashes of words, kept while there are few enough."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


PIECE, PLACES = 1 << 18, 64
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_GAPS = np.zeros(256, bool)
_GAPS[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: A random number for each byte at each place of a word: sums of them collide no more than chance has it.
_OF_PLACE = np.random.default_rng(22).integers(0, 2**64, (PLACES, 256), dtype=np.uint64).ravel()


def lower_word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of a text's words with A-Z lowered, by tabulation over all bytes at once.

    Texts are taken in pieces that end between words, so that memory is bounded; words of more than
    PLACES bytes are hashed one by one.
    """
    return placed_word_hashes(raw)[0]


def placed_word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """lower_word_hashes(), and the place where each word starts."""
    out, at = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        h, starts = _piece_hashes(raw[at:end])
        out.append((h, starts + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _piece_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    gap = _GAPS[b]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lead = starts[0]
    b, gap, starts = b[lead:], gap[lead:], starts - lead
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    values = _OF_PLACE[np.minimum(place, PLACES - 1) * 256 + _FOLD[b]]
    values[gap] = 0
    out = np.add.reduceat(values, starts)
    if len(b) > PLACES:
        sizes = np.add.reduceat(~gap, starts, dtype=np.int64)
        for k in np.flatnonzero(sizes > PLACES):
            at = lead + starts[k]
            out[k] = xxhash.xxh3_64_intdigest(raw[at : at + sizes[k]].lower())
    return out, starts + lead


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by position."""
    x = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        x = mixed(x * U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return x


def shingle_set(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; a text of fewer words is one shingle, one of none has none."""
    if not len(h):
        return h[:0]
    g = np.sort(gram_hashes(h, min(n, len(h))))
    first = np.ones(len(g), bool)
    np.not_equal(g[1:], g[:-1], out=first[1:])
    return g[first]
