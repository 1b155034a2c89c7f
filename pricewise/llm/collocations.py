"""Phrase collocations by SON partitioning: phrases of 2 to 5 words that occur together
more often than their parts let expect.

1. Every shard (the rows of a task, ``SHARD_BYTES`` of text at a time) is mined completely,
   level by level, at the support lowered in proportion to its share of the language's
   bytes, rounded up. A phrase with ``support`` occurrences in all reaches that in at least
   one shard: shares add up to one. Shards are formed and mined in the same job, so it does
   not matter how rows are dealt.
2. The locally frequent phrases of all shards are united: shortened hashes go, packed, to
   buckets, with what each has beyond the support of its shard less one. Elsewhere it has
   that at most, so a phrase whose sum stays below the support less those of all shards is
   no candidate. The others become a bitmap of a size that follows the input.
3. All candidates are counted exactly: each shard counts the phrases whose bit is set and
   whose parts are candidates, and their hashes and counts, packed, are summed in buckets.
   Other phrases that share a bit are counted like candidates and fall below the support.
4. Each frequent phrase is read once more, from a text in which a shard has seen it.
5. The parts of a candidate are at least as frequent as it is, so all counts that a score
   needs are in that one table; scores, cuts and maximality are joins on it, and the list
   of each language comes from lists of ``SALT`` parts.

Support is an absolute number, so shares of less than ``1 / support`` mine at 1: with more
than ``support`` shards of a language every phrase is sent with its count, and the sums of
step 2 alone tell the candidates. ``SHARD_BYTES`` is the lever: bigger shards need more memory.

Defined results. Null texts are empty, null languages are ``und`` (as are rows that say so).
Phrases are compared by hashes of 52 bits or more until they are read. Ids do not matter: repeated rows count as often as they stand. Texts longer than a
shard are a shard of their own, cut where a piece ends. An empty table gives no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmaps import holds, repeated
from .common import bound_batches, check_broadcast, materialise, slices, texts_bytes
from .words import classes, join, words_of

SUPPORT = 100
LONGEST = 5
TOP = 2000
SHARD_BYTES = 24 << 20
#: Bytes of text whose words are found at once.
SLICE = 1 << 18
#: Languages that a table may have (their sizes are handed to every task).
LANGUAGES = 100_000
#: Parts of a language in the first round of the top list.
SALT = 16
#: Bits of a hash, after those of its bucket, that tell candidates; and that tell counted phrases.
SHORT, LONG = 26, 48
#: Excess over a shard's support that is sent at most (a byte); enough for any sum that is needed.
EXCESS = 255
BLANKS, PIECES = b" \t", b".,;:!?\n\x0b\x0c\r"
_TABLE = classes(BLANKS, PIECES)


class Shard:
    """Words of one language in one shard: hashes, piece ends, and (for ``named`` words) places
    in the texts."""

    def __init__(self, named: bool):
        self.named = named
        self.hash, self.new, self.data, self.start, self.end, self.text, self.rows = [], [], [], [], [], [], []
        self.size = self.bytes = 0

    def add(self, texts: list[bytes], rows: list[int]) -> None:
        """Texts and the hashes of the rows they belong to."""
        w = words_of(texts, _TABLE, lower=True)
        self.text.append((w.text + len(self.rows)).astype(np.uint32))
        self.rows += rows
        self.hash.append(w.hash)
        self.new.append(w.new)
        if self.named:
            self.start.append((w.start + self.size).astype(np.uint32))
            self.end.append((w.end + self.size).astype(np.uint32))
            self.data.append(w.data)
        self.size += len(w.data)
        self.bytes += sum(len(t) for t in texts)

    def joined(self):
        hash_, new = np.concatenate(self.hash), np.concatenate(self.new)
        self.hash = self.new = None  # a shard is read once
        # words from each place to the end of its piece, up to LONGEST
        n = len(hash_)
        reach = np.full(n, LONGEST, dtype=np.int8)
        for k in range(LONGEST - 1, 0, -1):
            after = np.append(new[k:], np.ones(min(k, n), bool)) if n else new
            reach[after] = k
        return hash_, reach


def _encode(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each key, distinct keys, how often each occurs)."""
    coded = pa.array(keys).dictionary_encode()
    number = coded.indices.to_numpy()
    distinct = coded.dictionary.to_numpy()
    return number, distinct, np.bincount(number, minlength=len(distinct))


def levels(hash_: np.ndarray, reach: np.ndarray, frequent):
    """Phrases of 1 to ``LONGEST`` words, level by level: (length, hashes, counts, a place
    of each, all places, phrase number at each). ``frequent(hashes, counts)`` tells which to keep; a longer phrase is counted
    only where both its parts without the last and without the first word are kept."""
    at = np.arange(len(hash_), dtype=np.int32)
    number, keys, counts = _encode(hash_)
    for length in range(1, LONGEST + 1):
        keep = frequent(keys, counts)
        if not keep.any():
            return
        renamed = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        number = renamed[number]
        on = number >= 0
        at, number = at[on], number[on]
        keys, counts = keys[keep], counts[keep]
        place = np.empty(len(keys), dtype=np.int32)
        place[number] = at
        yield length, keys, counts, place, at, number
        # successors: the same level at the next word
        if length == LONGEST or len(at) < 2:
            return
        ok = (at[1:] == at[:-1] + 1) & (reach[at[:-1]] > length)
        pair, at = number[:-1][ok].astype(np.int64), at[:-1][ok]
        pair *= len(keys)
        pair += number[1:][ok]
        number, pair, counts = _encode(pair)
        last = hash_[place[pair % len(keys)] + length - 1]
        keys = join(keys[pair // len(keys)], last)


def _shards(batches, budget: int, named: bool = False):
    """Shards of a task's rows, by language: (language, Shard); every row is in one."""
    held: dict[str, tuple[Shard, list, list]] = {}
    total = 0

    def put(lang, text, row):
        nonlocal total
        shard, texts, rows = held.setdefault(lang, (Shard(named), [], []))
        texts.append(text)
        rows.append(row)
        total += len(text)
        if len(texts) >= 64 or sum(map(len, texts)) > SLICE:
            shard.add(texts, rows)
            texts.clear()
            rows.clear()

    def flush():
        nonlocal total
        while held:
            lang, (shard, texts, rows) = held.popitem()
            if texts:
                shard.add(texts, rows)
            if shard.bytes:
                yield lang, shard
            del shard
            pa.default_memory_pool().release_unused()
        total = 0

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            for lang, text, row in zip(part.column("lang").to_pylist(), texts_bytes(part), part.column("row").to_pylist()):
                for piece in _cut(text, budget):
                    if piece:
                        put(lang, piece, row)
                    if total >= budget:
                        yield from flush()
    yield from flush()


def _cut(text: bytes, budget: int):
    """``text`` in parts of about ``budget`` bytes that end where a piece ends."""
    while len(text) > budget:
        at = max(text.rfind(bytes([c]), 0, budget) for c in PIECES)
        if at < 0:
            at = min((p for p in (text.find(bytes([c]), budget) for c in PIECES) if p >= 0), default=len(text) - 1)
        yield text[:at + 1]
        text = text[at + 1:]
    yield text


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text"), F.xxhash64("text").alias("row"))


_PACKED = "bucket int, lang int, keys binary, n binary, row binary"


def _packed(bucket, lang, keys, n, row=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array([lang] * len(bucket), pa.int32()), pa.array(keys, pa.binary()), pa.array(n, pa.binary()),
         pa.array(row or [None] * len(bucket), pa.binary())], names=["bucket", "lang", "keys", "n", "row"])


def _squeezed(keys: np.ndarray, more: np.ndarray, buckets: int) -> tuple[bytes, bytes]:
    """Sorted hashes of a bucket as 16-bit steps between their ``SHORT`` bits after the
    bucket's, and the numbers that go with them. Long steps pass over entries with nothing."""
    short = ((keys << np.uint64(buckets)) >> np.uint64(64 - SHORT)).astype(np.int64)
    over, step = np.divmod(np.diff(short, prepend=0), 65535)
    at = np.arange(len(keys)) + np.cumsum(over)
    steps = np.full(int(over.sum()) + len(keys), 65535, dtype="<u2")
    numbers = np.zeros(len(steps), dtype=np.uint8)
    steps[at], numbers[at] = step, more
    return steps.tobytes(), numbers.tobytes()


def _stretched(steps: bytes) -> np.ndarray:
    """The ``SHORT`` bits of each entry."""
    return np.cumsum(np.frombuffer(steps, "<u2").astype(np.int64))


def _dealt_out(keys: np.ndarray, buckets: int, *columns):
    """(bucket, slice of the sorted keys, slices of the columns) of the non-empty buckets."""
    order = np.argsort(keys)
    keys, columns = keys[order], [c[order] for c in columns]
    edge = [0, *np.searchsorted(keys, np.arange(1, 1 << buckets, dtype=np.uint64) << np.uint64(64 - buckets)).tolist(), len(keys)]
    for b, (lo, hi) in enumerate(zip(edge, edge[1:])):
        if lo < hi:
            yield b, keys[lo:hi], [c[lo:hi] for c in columns]


def _gathered(batches, finish):
    """``finish(language, rows)`` for each language of each bucket (rows come sorted by bucket)."""
    held: dict[int, list] = {}
    bucket = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != bucket:
                for lang, own in held.items():
                    yield from finish(lang, own)
                held, bucket = {}, r["bucket"]
            held.setdefault(r["lang"], []).append(r)
    for lang, own in held.items():
        yield from finish(lang, own)


def _totals(rows: DataFrame) -> dict[int, int]:
    """Sums of the rows of bucket -1: one number for each language."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([int(np.frombuffer(m.as_py(), "<u8")[0]) for m in batch.column("n")], pa.int64())], names=["lang", "n"])

    found = rows.where("bucket = -1").mapInArrow(run, "lang int, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    return {r["lang"]: r["n"] for r in found.collect()}


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")


@dataclass(frozen=True)
class Plan:
    """Rows in as many tasks as there are shards (at least one for each core), the bytes and
    the number of each language, and the sizes of buckets and bitmaps."""

    rows: DataFrame
    sizes: dict[str, int]
    number: dict[str, int]
    bits: int
    buckets: int
    shard_bytes: int
    support: int


def plan(docs: DataFrame, support: int = SUPPORT, shard_bytes: int = SHARD_BYTES) -> Plan:
    spark = docs.sparkSession
    bound_batches(spark)
    rows = _rows(docs)
    # a language is one row, and at most LANGUAGES of them are handed out
    sizes = {r["lang"]: r["b"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"))
             .where("b > 0").limit(LANGUAGES + 1).collect()}
    check_broadcast(len(sizes), LANGUAGES, "languages")
    total = sum(sizes.values())
    tasks = max(-(-total // shard_bytes), spark.sparkContext.defaultParallelism)
    return Plan(rows.coalesce(tasks), sizes, {lang: k for k, lang in enumerate(sorted(sizes))}, min(31, max(20, (total // 8).bit_length())),
                max(4, (total // shard_bytes).bit_length()), shard_bytes, support)


def candidates(p: Plan) -> np.ndarray:
    """Bitmap of the phrases that can have the support, by what the shards found."""
    sizes, number, buckets, support, budget = p.sizes, p.number, p.buckets, p.support, p.shard_bytes

    def mine(batches):
        """Packed phrases of each shard, and as bucket -1 its support less one."""
        for lang, shard in _shards(batches, budget):
            least = max(1, -(-support * shard.bytes // sizes[lang]))
            salt = _salt(lang)
            hash_, reach = shard.joined()
            found = [(join(np.full(len(k), salt), k), n - (least - 1)) for _, k, n, *_ in levels(hash_, reach, lambda k, n, least=least: n >= least)]
            del hash_, reach
            yield _packed([-1], number[lang], [b""], [np.array([least - 1], "<u8").tobytes()])
            if found:
                keys, more = (np.concatenate(x) for x in zip(*found))
                own = list(_dealt_out(keys, buckets, np.minimum(more, EXCESS).astype(np.uint8)))
                data = [_squeezed(k, m, buckets) for _, k, (m,) in own]
                yield _packed([b for b, _, _ in own], number[lang], [k for k, _ in data], [m for _, m in data])

    mined = materialise(p.rows.mapInArrow(mine, _PACKED), "mined")
    need = {k: min(EXCESS, support - n) for k, n in _totals(mined).items()}

    def united(batches):
        def summed(lang, rows):
            keys = np.concatenate([_stretched(r["keys"]) for r in rows])
            more = np.concatenate([np.frombuffer(r["n"], np.uint8) for r in rows]).astype(np.int64)
            order = np.argsort(keys)
            keys, more = keys[order], more[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            keys = keys[first][np.add.reduceat(more, first) >= need[lang]].astype(np.uint64)
            high = np.uint64(rows[0]["bucket"]) << np.uint64(64 - buckets)
            yield high | keys << np.uint64(64 - SHORT - buckets)

        for found in _gathered(batches, summed):
            yield found, np.zeros(len(found), np.int64)

    # the bitmap takes the leading bits, which the shortened hashes have
    return repeated(_by_bucket(mined), united, hot=1 << 62, every=True, bits=min(p.bits, SHORT + buckets))[0]


def _salt(lang: str) -> np.uint64:
    """Hash of a language."""
    return words_of([lang.encode() or b"-"], np.zeros(256, np.uint8)).hash[0]


def counts(p: Plan, bitmap: np.ndarray) -> DataFrame:
    """``lang, size, phrase, n``: every phrase of 1 to ``LONGEST`` words with the support, and
    all words of a language as the phrase of size 0."""
    spark = p.rows.sparkSession
    number, buckets, support, budget = p.number, p.buckets, p.support, p.shard_bytes
    shared = spark.sparkContext.broadcast(bitmap)

    def found(shard, salt):
        hash_, reach = shard.joined()
        return hash_, levels(hash_, reach, lambda k, _: holds(shared.value, join(np.full(len(k), salt), k)))

    def count(batches):
        for lang, shard in _shards(batches, budget):
            salt = _salt(lang)
            text, rows = np.concatenate(shard.text), np.array(shard.rows, dtype=np.int64)
            shard.text = None
            hash_, phrases = found(shard, salt)
            yield _packed([-1], number[lang], [b""], [np.array([len(hash_)], "<u8").tobytes()])
            parts = [(join(np.full(len(k), salt), k), n, rows[text[place]]) for _, k, n, place, *_ in phrases]
            if parts:
                keys, n, row = (np.concatenate(x) for x in zip(*parts))
                # counts are bytes: a larger one stands in several entries
                times = n // 255 + 1
                left = n % 255
                keys, row, n = np.repeat(keys, times), np.repeat(row, times), np.full(int(times.sum()), 255)
                n[np.cumsum(times) - 1] = left
                own = list(_dealt_out(keys, buckets, n.astype(np.uint8), row))
                yield _packed([b for b, _, _ in own], number[lang], [_split(k, buckets) for _, k, _ in own],
                              [n.tobytes() for _, _, (n, _) in own], [(r >> 48).astype("<i2").tobytes() for _, _, (_, r) in own])

    counted = materialise(p.rows.mapInArrow(count, _PACKED), "counted")
    totals = _totals(counted)

    def summed(lang, rows):
        keys = np.concatenate([_whole(r["keys"], r["bucket"], buckets) for r in rows])
        n = np.concatenate([np.frombuffer(r["n"], np.uint8) for r in rows]).astype(np.int64)
        row = np.concatenate([np.frombuffer(r["row"], "<i2") for r in rows]).astype(np.int32)
        order = np.lexsort((row, keys))
        keys, n, row = keys[order], n[order], row[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n, keys, row = np.add.reduceat(n, first), keys[first], row[first]
        on = n >= support
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(on.sum(), lang, np.int32)), pa.array(keys[on].view(np.int64)), pa.array(n[on]), pa.array(row[on])], names=["lang", "key", "n", "row"])

    frequent = materialise(_by_bucket(counted).mapInArrow(lambda batches: _gathered(batches, summed), "lang int, key long, n long, row int"), "frequent")

    def seen(batches):
        for batch in batches:
            a = _seen(batch.column("key").to_numpy().view(np.uint64), batch.column("row").to_numpy())
            yield a, np.zeros(len(a), np.int64)

    marks = spark.sparkContext.broadcast(repeated(frequent, seen, hot=1 << 62, every=True, bits=min(p.bits, 28))[0])

    def name(batches):
        """Frequent phrases, where a task has the text that they are to be read from."""
        for lang, shard in _shards(batches, budget, True):
            salt = _salt(lang)
            data, start, end = np.concatenate(shard.data), np.concatenate(shard.start), np.concatenate(shard.end)
            text, rows = np.concatenate(shard.text), (np.array(shard.rows, dtype=np.int64) >> 48).astype(np.int32)
            shard.data = shard.start = shard.end = shard.text = None
            _, phrases = found(shard, salt)
            for size, keys, _, _, at, phrase in phrases:
                keys = _told(join(np.full(len(keys), salt), keys), buckets)
                on = holds(marks.value, _seen(keys[phrase], rows[text[at]]))
                number_, first = np.unique(phrase[on], return_index=True)
                place = at[on][first]
                words = [[data[a:b].tobytes() for a, b in zip(start[place + k].tolist(), end[place + k].tolist())] for k in range(size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number[lang]] * len(place), pa.int32()), pa.array(keys[number_].view(np.int64)), pa.array([size] * len(place), pa.int32()),
                     pa.array([b" ".join(w) for w in zip(*words)], pa.binary())], names=["lang", "key", "size", "phrase"])

    named = (p.rows.mapInArrow(name, "lang int, key long, size int, phrase binary").groupBy("lang", "key")
             .agg(F.first("size").alias("size"), F.first("phrase").cast("string").alias("phrase")))
    names = F.broadcast(spark.createDataFrame([(k, lang) for lang, k in number.items()], "lang int, name string"))  # at most LANGUAGES
    whole = spark.createDataFrame([(k, 0, "", n) for k, n in totals.items()], "lang int, size int, phrase string, n long")
    every = frequent.join(named, ["lang", "key"]).select("lang", "size", "phrase", "n").union(whole)
    return every.join(names, "lang").select(F.col("name").alias("lang"), "size", "phrase", "n")


def _told(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes cut to the bits that tell counted phrases."""
    spare = np.uint64(max(0, 64 - LONG - buckets))
    return keys >> spare << spare


def _split(keys: np.ndarray, buckets: int) -> bytes:
    """The ``LONG`` bits after the bucket's: their upper 32, then their lower 16."""
    own = (keys << np.uint64(buckets)) >> np.uint64(64 - LONG)
    return (own >> np.uint64(16)).astype("<u4").tobytes() + own.astype("<u2").tobytes()


def _whole(data: bytes, bucket: int, buckets: int) -> np.ndarray:
    n = len(data) // 6
    own = np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64)
    return np.uint64(bucket) << np.uint64(64 - buckets) | own << np.uint64(64 - LONG) >> np.uint64(buckets)


def _seen(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hash of a phrase and the text that it is to be read from."""
    return join(keys, row.astype(np.int64).view(np.uint64))


def scored(frequent: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lang, size, phrase, a, l, r, n, score`` of every candidate, with its lowest cut
    (of equal ones the earliest)."""
    words = F.split("phrase", " ")
    cuts = (frequent.where("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), words.alias("_w"))
            .select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "size", "phrase", "a", "k", F.concat_ws(" ", F.slice("_w", F.lit(1), F.col("k"))).alias("_left"),
                    F.concat_ws(" ", F.slice("_w", F.col("k") + 1, F.col("size"))).alias("_right")))
    parts = frequent.where(f"size BETWEEN 1 AND {LONGEST - 1}")
    total = F.broadcast(frequent.where("size = 0").select("lang", F.col("n").alias("n")))  # a row a language
    both = (cuts.join(parts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l")), ["lang", "_left"])
            .join(parts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r")), ["lang", "_right"])
            .join(total, "lang"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("_top", (wide("a") * wide("n")).cast("decimal(35,0)")).withColumn("_bottom", (wide("l") * wide("r")).cast("decimal(38,0)"))
    both = both.withColumn("score", F.expr("CAST(_top * CAST(1000 AS DECIMAL(4,0)) AS DECIMAL(38,0)) div _bottom"))
    low = both.groupBy("lang", "size", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    return low.select("lang", "size", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def maximal(found: DataFrame) -> DataFrame:
    """Candidates that do not lie in a longer one that is as frequent. A longer one by
    several words has one by a single word between, at least as frequent as itself."""
    words = F.split("phrase", " ")
    inner = (found.where("size >= 3").select("lang", F.col("a").alias("_a"), F.explode(F.array(
        F.concat_ws(" ", F.slice(words, F.lit(1), F.col("size") - 1)),
        F.concat_ws(" ", F.slice(words, F.lit(2), F.col("size") - 1)))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("_a").alias("_a")))
    return found.join(inner, ["lang", "phrase"], "left").where("_a IS NULL OR _a < a").drop("_a")


def top(found: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` of each language: first of each of ``SALT`` parts of it, so that
    no task gets more than ``SALT * most`` rows of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "_part").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    return (found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).withColumn("_rank", F.row_number().over(part))
            .where(F.col("_rank") <= most).withColumn("rank", F.row_number().over(whole).cast("long")).where(F.col("rank") <= most)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def phrases(docs: DataFrame, support: int = SUPPORT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, size, phrase, n`` of all phrases with at least ``support`` occurrences (see ``counts``)."""
    p = plan(docs, support, shard_bytes)
    if not p.sizes:
        return docs.sparkSession.createDataFrame([], "lang string, size int, phrase string, n long")
    return materialise(counts(p, candidates(p)), "phrases")


def collocations(docs: DataFrame, support: int = SUPPORT, most: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the best phrases of each language."""
    return top(maximal(scored(phrases(docs, support, shard_bytes), support)), most)


def oracle(support: int = SUPPORT, most: int = TOP) -> str:
    """DuckDB SQL: all phrases of up to five words, counted plainly."""
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY 1),
sized AS (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS size FROM worded WHERE len(w) > 0),
placed AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM sized WHERE len(w) >= size),
frequent AS (SELECT lang, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS phrase, count(*)::BIGINT AS a
  FROM placed GROUP BY 1, 2, 3 HAVING count(*) >= {support}),
cuts AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM frequent WHERE size >= 2),
scores AS (SELECT c.lang, c.size, c.phrase, c.a, k, x.a AS l, y.a AS r, n,
    ((1000::HUGEINT * c.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT))::BIGINT AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.size), ' ')
  JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM lowest a WHERE NOT EXISTS (SELECT 1 FROM lowest b WHERE b.lang = a.lang AND b.size > a.size
  AND 100 * b.a >= 100 * a.a AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= {most}
"""
