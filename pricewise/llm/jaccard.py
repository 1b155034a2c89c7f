"""N-gram Jaccard join with token-combination prefixes.

A document's set is that of its distinct word shingles, each named by a 64-bit
hash. Sets that are equal are one node (named by a 64-bit hash of the set), so
exact copies never meet in pairs. Two nodes link when
``100 * intersection >= percent * union``.

Candidates come from signatures over a global token order: rare class first,
then frequent tokens by how frequent they are. How frequent follows from counts
of hash buckets over all documents (``BUCKETS`` counters, whatever the input): a
token is frequent when its bucket holds clearly more than an even share. Any order
gives exact results; this one keeps shared passages out of the signatures.

With at most ``t = n - ceil(percent * n / 100)`` tokens of a set of ``n`` missing in a
partner, a prefix in which every choice of ``t`` missing tokens still leaves a
signature is enough. A rare token is a signature by itself and counts 1. Frequent
tokens fall into groups by hash; each pair within a group is a signature, and a
group of ``k`` tokens counts ``k - 1``. The prefix is extended until the counts pass
``t``. The number of groups follows from the size class, a power of two; a set
also writes the signatures of the class below where a partner may be in it. Large
classes use pairs for all tokens.

Links are found in two steps, so that a bucket of many near copies does not
emit all pairs: every node is compared with one head of its buckets, verified
pairs form components, and then all pairs of a bucket across components are
compared. Pairs inside a component need no test, as only components are asked for.
Before whole sets are compared, parity bits bound the overlap of a pair from above,
first inside the join that would make the pair.

Null and empty texts have the empty set, which links with nothing. A row without
``doc_id`` takes part, but names no component. Equal 64-bit hashes of different
shingles or sets count as equal (2**-64 for a pair).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import holds, id_keys, of_ids, repeated
from .common import bound_batches, materialise, slices, texts_bytes

BUCKETS = 1 << 20
PARITY_BITS = 1024
#: Sets with so many groups (a quarter of their size class) use pairs for rare tokens too:
#: of the hundreds of tokens that a large set may lack, single ones are shared by chance.
PAIR_GROUPS = 256
WORDS = PARITY_BITS // 64
CHUNK = 1 << 14
#: A bucket is frequent beyond the even share by this many standard deviations.
DEVIATIONS = 6.0
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def token_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``size`` words (of
    the whole sequence, where there are fewer)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = _mix((h * _M1) ^ w[k:len(w) - n + 1 + k])
    return np.unique(h)


def node_of(tokens: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.array([xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))], dtype=np.uint64).view(np.int64)[0])


def missing(n: int, percent: int) -> int:
    """Most tokens of a set of ``n`` that a partner may lack."""
    return n - -(-percent * n // 100)


def groups_of(n: int) -> int:
    return max(1, (1 << (n.bit_length() - 1)) // 4)


def signatures(tokens: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of a set; ``level`` is 0 for rare tokens, else grows with the frequency."""
    n = len(tokens)
    least = -(-percent * n // 100)
    if n < 2 or 100 * n < percent * (n + 1) and 100 * (n - 1) < percent * n:
        return np.empty(0, dtype=np.uint64)  # any partner would be equal
    t = n - least
    out = []
    for groups in {groups_of(n), groups_of(least)}:
        if groups >= PAIR_GROUPS:  # a large set: pairs for all tokens
            out.append(_pairs(tokens[np.lexsort((tokens, level))], groups, t + 1))
            continue
        rare = tokens[level == 0][:t + 1]
        out.append(_mix(rare * _M1))
        if t + 1 > len(rare):
            often, how = tokens[level > 0], level[level > 0]
            out.append(_pairs(often[np.lexsort((often, how))], groups, t + 1 - len(rare)))
    return np.unique(np.concatenate(out))


def _pairs(often: np.ndarray, groups: int, need: int) -> np.ndarray:
    """Pairs within groups of the shortest prefix of ``often`` that counts ``need``."""
    group = (often >> np.uint64(40)) % np.uint64(groups)
    seen, count, stop = set(), 0, len(often)
    for i, g in enumerate(group.tolist()):
        if g in seen:
            count += 1
            if count >= need:
                stop = i + 1
                break
        seen.add(g)
    members: dict[int, list[int]] = {}
    a, b = [], []
    for i, g in enumerate(group[:stop].tolist()):
        for j in members.get(g, ()):
            a.append(j)
            b.append(i)
        members.setdefault(g, []).append(i)
    lo, hi = np.minimum(often[a], often[b]), np.maximum(often[a], often[b])
    return _mix(_mix(lo * _M1 + np.uint64(groups)) ^ (hi * _M2))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bits of a set: how many of its tokens fall on each, modulo 2. Two sets differ
    in at least as many tokens as their bits differ in places. There are as many bits
    as tokens, rounded down to a power of two, and ``PARITY_BITS`` at least; the two
    halves of the bits, added, are the bits of half the length."""
    size = max(PARITY_BITS, 1 << (len(tokens).bit_length() - 1))
    odd = np.bincount(((tokens >> np.uint64(20)) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _packed(counts: np.ndarray) -> bytes:
    """Counters of a chunk; a task with little input sends those that are not zero."""
    at = np.flatnonzero(counts)
    if 6 * len(at) < 4 * CHUNK - 8:
        return at.astype("<u2").tobytes() + counts[at].astype("<u4").tobytes()
    return counts.astype("<u4").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    if len(blob) == 4 * CHUNK:
        return np.frombuffer(blob, dtype="<u4").astype(np.int64)
    n = len(blob) // 6
    out = np.zeros(CHUNK, dtype=np.int64)
    out[np.frombuffer(blob, "<u2", n)] = np.frombuffer(blob, "<u4", n, 2 * n)
    return out


def profile(docs: DataFrame, size: int, text_col: str = "text", keyed: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n_shingles, node, parity bits of every row; token level by hash
    bucket), in one pass; ``keyed`` rows have the hash of the text, too."""
    spark = docs.sparkSession
    bound_batches(spark)
    key = ["text_key"] if keyed else []

    def run(batches):
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                sets = [token_set(t, size) for t in texts_bytes(part, text_col)]
                for s in sets:
                    np.add.at(counts, (s & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                yield _rows(part.column("doc_id"), [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets],
                            [parity(s) if len(s) else None for s in sets], [part.column(c) for c in key])
        for k in range(BUCKETS // CHUNK) if counts.any() else ():
            yield _rows(pa.nulls(1, pa.int64()), [None], [None], [None], [pa.nulls(1, pa.int64()) for _ in key], k, _packed(counts[k * CHUNK:(k + 1) * CHUNK]))

    def _rows(ids, n, node, bits, keys, chunk=None, blob=None):
        m = len(n)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array([chunk] * m, pa.int32()),
             pa.array([blob] * m, pa.binary()), *keys], names=["doc_id", "n_shingles", "node", "bits", "chunk", "counts", *key])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col, *[F.xxhash64(text_col).alias(c) for c in key])
    every = materialise(own.mapInArrow(
        run, "doc_id long, n_shingles long, node long, bits array<long>, chunk int, counts binary"
        + "".join(f", {c} long" for c in key)), "profile")
    return (every.where("chunk IS NULL").select("doc_id", "n_shingles", "node", "bits", *key),
            _levels(every.where("chunk IS NOT NULL").select("chunk", "counts")))


def _levels(parts: DataFrame) -> np.ndarray:
    """Add up the tasks' counters and turn them into levels: ``BUCKETS`` small numbers."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                c = _unpacked(blob)
                total[k] = total[k] + c if k in total else c
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c.tobytes()], pa.binary())],
                                             names=["chunk", "counts"])

    counts = np.zeros(BUCKETS)
    for r in parts.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        counts[r["chunk"] * CHUNK:(r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], dtype="<i8")
    even = float(np.median(counts))
    over = counts - even - DEVIATIONS * np.sqrt(even + 1)
    return np.where(over > 0, 1 + np.log2(np.maximum(over, 1)).astype(int), 0).astype(np.uint8)


def signature_rows(docs: DataFrame, level: np.ndarray, size: int, percent: int, text_col: str = "text") -> DataFrame:
    """``sig, node, n``, once per node in a task."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(level)

    def run(batches):
        done: set[int] = set()
        table = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                sig, node, n = [], [], []
                for text in texts_bytes(part, text_col):
                    s = token_set(text, size)
                    name = node_of(s)
                    if name in done:
                        continue
                    done.add(name)
                    own = signatures(s, table[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], percent)
                    if len(own):
                        sig.append(own)
                        node.append(np.full(len(own), name))
                        n.append(np.full(len(own), len(s), dtype=np.int32))
                if sig:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node)),
                         pa.array(np.concatenate(n))], names=["sig", "node", "n"])

    return docs.select(text_col).mapInArrow(run, "sig long, node long, n int")


def sets_of(docs: DataFrame, wanted: np.ndarray, size: int, text_col: str = "text") -> DataFrame:
    """``node, tokens`` of the rows whose ids the bitmap ``wanted`` has."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(holds(shared.value, id_keys(batch.column("doc_id")))))
            for part in slices(batch, text_col):
                sets = [s for s in (token_set(t, size) for t in texts_bytes(part, text_col)) if len(s)]
                if sets:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([node_of(s) for s in sets], pa.int64()),
                         pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col).mapInArrow(run, "node long, tokens array<long>")


def _half(bits: str) -> Column:
    n = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, 1, n), F.slice(bits, n + 1, n), lambda x, y: x.bitwiseXOR(y))


def _fold(bits: str, word: int) -> Column:
    """One word of the bits folded to the shortest length."""
    return F.aggregate(F.sequence(F.lit(word), F.size(bits) - 1, F.lit(WORDS)), F.lit(0).cast("long"),
                       lambda s, k: s.bitwiseXOR(F.get(bits, k)))


def plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose parity bits allow a link: with sizes n and m and d places
    that differ, at most (n + m - d) / 2 tokens are shared."""
    both = (pairs.join(marks.select(F.col("node").alias("a"), F.col("bits").alias("ba"), F.col("n_shingles").alias("na")), "a")
            .join(marks.select(F.col("node").alias("b"), F.col("bits").alias("bb"), F.col("n_shingles").alias("nb")), "b"))
    both = both.where(_fits(F.col("na"), F.col("nb"), percent))  # so one is at most twice as long
    a = F.when(F.size("ba") > F.size("bb"), _half("ba")).otherwise(F.col("ba"))
    b = F.when(F.size("bb") > F.size("ba"), _half("bb")).otherwise(F.col("bb"))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("na") + F.col("nb")
    return both.where((total - differ) * (100 + percent) >= 2 * percent * total).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, percent: int, text_col: str, name: str) -> DataFrame:
    """The pairs ``a, b`` that link, by their whole sets. One row of each node is
    wanted; a bitmap of the wanted ids picks the texts where they are read."""
    nodes = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), f"{name}-nodes")
    ids = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")

    wanted = of_ids(ids)
    sets = materialise(sets_of(docs, wanted, size, text_col), f"{name}-sets")
    sets = sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b"))
    shared = F.size(F.array_intersect("ta", "tb"))
    total = F.size("ta") + F.size("tb")
    return materialise(both.where(shared * (100 + percent) >= percent * total).select("a", "b"), f"{name}-links")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, comp``: the smallest node reachable over the edges ``a, b``, for every
    node with an edge. Smallest labels spread to neighbours, and labels then follow
    their own label, until nothing changes."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
        edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = materialise(both.distinct(), f"{name}-edges")
    label = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        spread = label.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("comp").alias("top"))
        new = materialise(spread.join(up, "mid", "left").select(
            "node", "was", F.least("mid", F.coalesce("top", "mid")).alias("comp")), f"{name}-{step}")
        label = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            return label


def _fits(n, m, percent):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _shared(sigs: DataFrame) -> DataFrame:
    """The signature rows whose signature two nodes have, with the head of each
    signature. Most signatures have one node: a bitmap drops those before anything
    is dealt out by signature. The head is the node whose signatures are shared most:
    of a text and its edited copies that is the text, which links with them all."""

    def keys(batches):
        for batch in batches:
            yield batch.column("sig").to_numpy().view(np.uint64), batch.column("node").to_numpy()

    bitmap, _ = repeated(sigs.select("sig", "node"), keys, hot=1 << 62)
    known = sigs.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(holds(known.value, batch.column("sig").to_numpy().view(np.uint64))))

    left = materialise(sigs.mapInArrow(keep, sigs.schema), "signatures-left")
    several = left.groupBy("sig").agg(F.min("node").alias("_first"), F.max("node").alias("_last"), F.count("*").alias("size"))
    several = several.where("_first <> _last").select("sig", "size")
    shared = materialise(left.join(several, "sig").dropDuplicates(["sig", "node"]), "signatures-shared")
    central = shared.groupBy("node").agg(F.sum("size").alias("central"))
    heads = shared.join(central, "node").groupBy("sig").agg(F.max_by("node", F.struct("central", "node")).alias("head"))
    return materialise(shared.drop("size").join(heads, "sig"), "signatures-headed")


def cluster(docs: DataFrame, size: int, percent: int, text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``, the
    smallest doc_id among documents reachable by links. ``percent`` is 50 or more.
    ``keyed`` adds ``text_key``, the xxhash64 of the text, which tells rows of one id apart."""
    if not 50 <= percent <= 100:
        raise ValueError("percent from 50 to 100")
    rows, level = profile(docs, size, text_col, keyed)
    key = ["text_key"] if keyed else []
    shared = _shared(materialise(signature_rows(docs, level, size, percent, text_col), "signatures"))
    marks = materialise(rows.where("node IS NOT NULL").join(shared.select("node").distinct(), "node", "left_semi")
                        .groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits")), "marks")

    # first every node with the head it shares most signatures with
    votes = shared.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("votes"))
    first = votes.groupBy("node").agg(F.max_by("head", F.struct("votes", "head")).alias("head"))
    first = materialise(plausible(_ordered(first.select(F.col("node").alias("x"), F.col("head").alias("y"))), marks, percent), "pairs-1")
    links = verified(first, docs, rows, size, percent, text_col, "step-1")
    label = components(links, "components-1")

    # then what shares a signature across components
    words = [f"w{i}" for i in range(WORDS)]
    folded = marks.select("node", *[_fold("bits", i).alias(w) for i, w in enumerate(words)])
    member = materialise(shared.select("sig", "node", "n").join(label, "node", "left")
                         .select("sig", "node", "n", F.coalesce("comp", "node").alias("comp")), "members")
    open_ = member.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    member = member.join(open_, "sig", "left_semi").join(folded, "node")
    x = member.select("sig", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "comp", *words)])
    y = member.select("sig", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "comp", *words)])
    differ = sum((F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in words), F.lit(0))
    total = F.col("x_n") + F.col("y_n")
    # the bounds are part of the join: what they exclude is no row of it
    cross = x.join(y, (x["sig"] == y["sig"]) & (F.col("x_comp") < F.col("y_comp")) & _fits(F.col("x_n"), F.col("y_n"), percent)
                   & ((total - differ) * (100 + percent) >= 2 * percent * total)).select(
        F.col("x_node").alias("x"), F.col("y_node").alias("y"))
    cross = _ordered(cross).join(first, ["a", "b"], "left_anti")
    more = verified(materialise(plausible(cross, marks, percent), "pairs-2"), docs, rows, size, percent, text_col, "step-2")
    label = components(links.union(more), "components-2")

    named = rows.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = named.where("comp IS NOT NULL").join(smallest, "comp").select("doc_id", "n_shingles", "component_id", *key)
    alone = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *key)
    return linked.union(alone)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def oracle(size: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for ``cluster``: overlap counts of all pairs that share a shingle."""
    parts = " || chr(31) || ".join(f"w[i + {k}]" for k in range(size))
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, {parts} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM words WHERE len(w) >= {size})
    UNION ALL SELECT doc_id, array_to_string(w, chr(31)) FROM words WHERE len(w) BETWEEN 1 AND {size - 1})),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
mutual AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN mutual e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id, n
"""
