"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns, from a bounded sample, a rotation of the centred
principal axes whose signs are balanced bits that lose little of the vectors: it
alternates between rounding to the nearest signs and the best rotation for them.
The bits are cut into ``tables`` substrings. Vectors that agree on a substring
meet in a bucket of its table, are compared by Hamming distance, and those close
enough are compared exactly, with the original vectors in double precision. A
pair that meets in several tables counts in the first only, which its two codes
tell without any exchange.

What is found is measured, not modelled: pairs are made at the limit from the
sample, towards other vectors of it and in random directions. Keys of further
bits, drawn at random, are added to the substrings until ``share`` of either kind
of these pairs agree on one. So many bits to a key are too few for labels with
very many vectors: their buckets would grow in proportion. There, keys are drawn
of more bits each, and as many of them as find that share again. Each label is
planned for by itself. The bits of a key grow with the logarithm of the vectors,
up to twice as many, where a vector meets about a thousandth part of its label,
one in 65,536 in each table.

Equal vectors of a label are one class from the start. Buckets are worked off
twice. First only codes meet; what comes out is which vectors have another one
within the radius in a bucket. Only those then meet again with their vectors, in
groups a quarter as large. A
bucket emits counts and spanning links, never its pairs. Crowded buckets are
dealt out in groups of half of ``bucket_rows``; every two groups meet in a task of
their own, so that none holds more and no pair is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.components import connected_components
from gradus.llm.sampling import per_label
from gradus.llm.simhash import unite
from gradus.llm.tables import cut


@dataclass
class Quantiser:
    mean: np.ndarray
    rotation: np.ndarray  # (dimension, bits)
    apart: list[np.ndarray]  # differing bits of pairs at the limit, of each kind

    @classmethod
    def fit(cls, x: np.ndarray, least: float, rounds: int = 40, seed: int = 9) -> Quantiser:
        """x: unit vectors, one a row. As many bits as dimensions, 64 at most."""
        mean, rng = x.mean(axis=0), np.random.default_rng(seed)
        centred = x - mean
        bits = min(64, x.shape[1])
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
        flat = centred @ axes
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        out = cls(mean, axes @ turn, [])
        for towards in (x[rng.permutation(len(x))] - x, rng.normal(size=x.shape)):
            towards = towards - (towards * x).sum(axis=1, keepdims=True) * x
            size = np.sqrt((towards**2).sum(axis=1))
            own, towards = x[size > 1e-9], towards[size > 1e-9] / size[size > 1e-9, None]
            if len(own):
                out.apart.append(out.codes(own) ^ out.codes(least * own + np.sqrt(max(0.0, 1 - least**2)) * towards))
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(x), 64), np.uint8)
        bits[:, : self.rotation.shape[1]] = (x - self.mean) @ self.rotation >= 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]

    def share(self, masks: list[int]) -> float:
        """How many in one of the made pairs agree on one of the masks, for the kind that is found least."""
        agree = lambda apart: np.any([(apart & np.uint64(m)) == 0 for m in masks], axis=0).mean()
        return min((float(agree(x)) for x in self.apart), default=1.0)

    def radius(self, loss: float = 2e-3) -> int:
        """Differing bits up to which codes are compared exactly: at most ``loss`` in one of the made pairs differ in more.

        Of short vectors, of up to 16 bits, all are.
        """
        bits = self.rotation.shape[1]
        return bits if bits <= 16 or not self.apart else max(int(np.quantile(np.bitwise_count(x), 1 - loss, method="higher")) for x in self.apart)


def key_bits(rows: int, size: int, tables: int, bucket_rows: int) -> int:
    """Bits of a key, so that ``rows`` vectors of one label, with even codes, fill buckets to a quarter at most.

    Twice the bits of a substring at most: wider keys would take too many tables.
    """
    narrow = width = max(1, min(64, size) // tables)
    while (rows >> width) * 4 > bucket_rows and width + 2 <= 2 * narrow:
        width += 2
    return width


def key_masks(quantiser: Quantiser, width: int, tables: int, share: float, most: int = 512) -> list[int]:
    """The bits of each key: ``tables`` substrings if ``width`` is theirs, and as many drawn ones as find ``share`` of the made pairs.

    If ``most`` keys find less, one key without bits: then all vectors of a label and
    length meet, as in the exact mode.
    """
    bits, rng, masks = quantiser.rotation.shape[1], np.random.default_rng(width), []
    if width <= bits // tables or bits < tables:
        masks = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(bits), tables)]
        width = max(1, bits // tables)
    while not masks or quantiser.share(masks) < share:
        if len(masks) >= most:
            return [0]
        masks.append(sum(1 << int(b) for b in rng.choice(bits, width, replace=False)))
    return masks


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _usable() -> Column:
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def fit(classes: DataFrame, least: float, sample: int = 4000, seed: int = 31) -> dict[int, Quantiser]:
    """A quantiser for each vector length, from about ``sample`` classes of each, at most twice as many."""
    rows = per_label(classes.select(F.col("node").alias("doc_id"), F.size("v").alias("size"), "v"), "size", sample, seed).collect()
    by_size: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        by_size.setdefault(r["size"], []).append(r["v"])
    return {n: Quantiser.fit(unit(np.array(v)), least) for n, v in by_size.items()}


@dataclass
class Plan:
    """Key masks by vector length, and those of crowded labels, of more bits, by length and bits; radius by length."""

    masks: dict[tuple[int, int], list[int]]
    wide: dict[int, int]  # hash of label and length -> bits of a key; others have 0, the substrings
    radius: dict[int, int]

    def of(self, of: int, size: int) -> list[int]:
        return self.masks[size, self.wide.get(of, 0)]


def plan_keys(classes: DataFrame, quantisers: dict[int, Quantiser], tables: int, bucket_rows: int, share: float) -> Plan:
    """By the number of vectors of each label and length; one row per crowded label reaches the driver."""
    groups = classes.groupBy(_group().alias("of"), F.size("v").alias("size")).agg(F.count("*").alias("n"))
    crowded = groups.where(f"shiftright(n, greatest(1, least(64, size) div {tables})) * 4 > {bucket_rows}").collect()
    masks, wide = {(n, 0): key_masks(q, 0, tables, share) for n, q in quantisers.items()}, {}
    for r in crowded:
        width = wide[r["of"]] = key_bits(r["n"], r["size"], tables, bucket_rows)
        if (r["size"], width) not in masks:
            masks[r["size"], width] = key_masks(quantisers[r["size"]], width, tables, share)
    return Plan(masks, wide, {n: q.radius() for n, q in quantisers.items()})


def _group() -> Column:
    return F.xxhash64("label", F.size("v"))


def encode(classes: DataFrame, quantisers: dict[int, Quantiser], plan: Plan) -> DataFrame:
    """``classes`` with the code of each vector and the bits of its keys, one for each table."""

    def run(batches):
        for batch in batches:
            v = batch.column(3)
            sizes, codes = pc.list_value_length(v).to_numpy(), np.zeros(batch.num_rows, np.uint64)
            groups = batch.column(1).to_numpy()
            bits = np.array([plan.wide.get(g, 0) for g in groups.tolist()], np.int64)
            kinds = list(zip(sizes.tolist(), bits.tolist(), strict=True))
            ends = np.cumsum([0, *(len(plan.masks[k]) for k in kinds)])
            keys = np.zeros(ends[-1], np.uint64)
            for n, width in sorted(set(kinds)):
                at, own = np.flatnonzero((sizes == n) & (bits == width)), np.array(plan.masks[n, width], np.uint64)
                codes[at] = quantisers[n].codes(unit(_matrix(v.take(pa.array(at)))))
                keys[ends[at][:, None] + np.arange(len(own))] = codes[at][:, None] & own
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64)), listed], [*batch.schema.names, "code", "keys"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("node", _group().alias("of"), "copies", "v").mapInArrow(
        run, f"node long, of long, copies long, v {kind}, code long, keys array<long>"
    )


# ------------------------------------------------------------------ comparison
BUCKET = ("of", "t", "key", "slice")


@dataclass
class Rows:
    """Vectors of one bucket: ids and codes, and in the second pass numbers of copies and unit vectors."""

    node: np.ndarray
    code: np.ndarray
    size: int
    copies: np.ndarray | None = None
    unit: np.ndarray | None = None

    def part(self, lo: int, hi: int) -> Rows:
        cut = lambda x: None if x is None else x[lo:hi]
        return Rows(self.node[lo:hi], self.code[lo:hi], self.size, cut(self.copies), cut(self.unit))

    @classmethod
    def join(cls, parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        every = lambda n: None if getattr(parts[0], n) is None else np.concatenate([getattr(p, n) for p in parts])
        return cls(every("node"), every("code"), parts[0].size, every("copies"), every("unit"))


def candidates(q: Rows, c: Rows, t: int, masks: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of q and c within the radius that meet in table t for the first time."""
    apart = q.code[:, None] ^ c.code[None, :]
    i, j = np.nonzero((np.bitwise_count(apart) <= radius) & (q.node[:, None] != c.node[None, :]))
    for mask in masks[:t]:
        new = (apart[i, j] & np.uint64(mask)) != 0
        i, j = i[new], j[new]
    return i, j


def close(q: Rows, c: Rows, i: np.ndarray, j: np.ndarray, least: float, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Those of the index pairs that link."""
    cosine = [(q.unit[i[k : k + block]] * c.unit[j[k : k + block]]).sum(axis=1) for k in range(0, len(i), block)]
    linked = np.concatenate([*cosine, np.zeros(0)]) >= least
    return i[linked], j[linked]


def _meetings(batches):
    """(bucket, rows, rows of the group that they meet, whether that is their own) of rows sorted by bucket and side."""
    at, own, held, across = None, [], None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        x = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names if n != "v"}
        cuts = np.zeros(batch.num_rows, bool)
        for n in (*BUCKET, "side"):
            cuts[1:] |= x[n][1:] != x[n][:-1]
        edges = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(x[n][lo] for n in BUCKET)
            if own and (key != at or x["side"][lo]):
                held, own = Rows.join(own), []
                if not across:
                    yield at, held, held, True
            if key != at:
                at, held, across = key, None, bool(x["across"][lo])
            v = unit(_matrix(batch.column("v").slice(lo, hi - lo))) if "v" in names else None
            rows = Rows(x["node"][lo:hi], x["code"][lo:hi].view(np.uint64), int(x["size"][lo]), x["copies"][lo:hi] if v is not None else None, v)
            if not x["side"][lo]:
                own.append(rows)
            elif held is not None:
                yield at, rows, held, False
    if own and not across:
        held = Rows.join(own)
        yield at, held, held, True


def _flag(plan: Plan, block: int = 512):
    """Codes -> (node, of, t, key) of the vectors that have another one within the radius in a bucket."""

    def run(batches):
        for (of, t, key, _), rows, held, _ in _meetings(batches):
            found = []
            for lo in range(0, len(rows.node), block):
                q = rows.part(lo, lo + block)
                i, j = candidates(q, held, int(t), plan.of(int(of), rows.size), plan.radius[rows.size])
                found += [q.node[np.unique(i)], held.node[np.unique(j)]]
            node = np.unique(np.concatenate(found))
            if len(node):
                same = [pa.array(np.full(len(node), x)) for x in (of, t, key)]
                yield pa.RecordBatch.from_arrays([pa.array(node), *same], ["node", *BUCKET[:3]])

    return run


def _compare(least: float, plan: Plan, block: int = 512):
    """Vectors -> (a, n): link counts, and (a, b): spanning links."""

    def run(batches):
        for (of, t, _, _), rows, held, same in _meetings(batches):
            for lo in range(0, len(rows.node), block):
                q = rows.part(lo, lo + block)
                i, j = close(q, held, *candidates(q, held, int(t), plan.of(int(of), rows.size), plan.radius[rows.size]), least)
                if not len(i):
                    continue
                counts = np.bincount(i, held.copies[j], len(q.node)).astype(np.int64)
                # two groups meet once: both sides count
                back = np.zeros(len(held.node), np.int64) if same else np.bincount(j, q.copies[i], len(held.node)).astype(np.int64)
                parent = np.arange(len(q.node) + len(held.node))
                unite(parent, i, j + len(q.node))
                names, far = np.concatenate([q.node, held.node]), np.flatnonzero(parent != np.arange(len(parent)))
                counted, numbers = np.flatnonzero(np.concatenate([counts, back])), np.concatenate([counts, back])
                a = np.concatenate([names[counted], names[far]])
                link = np.arange(len(a)) >= len(counted)
                b = pa.array(np.concatenate([counted, names[parent[far]]]), mask=~link)
                n = pa.array(np.concatenate([numbers[counted], far]), mask=link)
                yield pa.RecordBatch.from_arrays([pa.array(a), b, n], ["a", "b", "n"])

    return run


def _dealt(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` with the slice of the bucket and the side of it that each goes to, as often as it has slices to go to.

    A crowded bucket has ``groups`` groups of half of ``bucket_rows`` and a slice for
    each two of them; in the slice (i, j) group i is side 0, group j side 1.
    """
    half = max(1, bucket_rows // 2)
    crowded = rows.groupBy(*BUCKET[:3]).agg(F.count("*").alias("rows")).where(f"rows > {bucket_rows}")
    placed = rows.join(crowded, list(BUCKET[:3]), "left").withColumn("groups", F.coalesce(F.ceil(F.col("rows") / half), F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("groups"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return placed.withColumns({"slice": low * F.col("groups") + high, "side": (F.col("mine") > F.col("other")).cast("int"), "across": (low < high).cast("int")}).drop(
        "rows", "groups", "mine", "other"
    )


def _met(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET, "side", "node")


def near_duplicates(
    vectors: DataFrame, least: float = 0.93, tables: int = 8, bucket_rows: int = 2048, sample: int = 4000, share: float = 0.985, exact: bool = False
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors of the same label and length link if their cosine is at least
    ``least``; n_links counts the other rows linked directly, component_id is the
    smallest vec_id reachable by links, and kept says whether that is the row's
    own. Vectors that are null, zero or hold null or non-finite components link
    with nothing, and so do rows without vec_id or label. Rows that repeat a vec_id
    count as vectors of their own. Other columns are ignored.

    Keys are added until ``share`` of the pairs made at the limit from the sample
    meet; at higher cosines hardly any pair is missed. Codes that differ in more
    bits than two in a thousand of the made pairs do are not compared exactly;
    vectors of up to 16 numbers are compared whatever their codes. With ``exact``
    all vectors of a label meet, in as many tasks as it takes, and none is missed.
    """
    fine = vectors.where(_usable()).select("vec_id", "label", _stored(vectors).alias("v"))
    classes = fine.groupBy("label", "v").agg(F.min("vec_id").cast("long").alias("first"), F.count("*").alias("copies"))
    # written once, so that the numbers given here stay
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    quantisers = fit(classes, least, sample)
    if exact:
        plan = Plan({(n, 0): [0] for n in quantisers}, {}, dict.fromkeys(quantisers, 64))
    else:
        plan = plan_keys(classes, quantisers, tables, bucket_rows, share)
    coded = cut(encode(classes, quantisers, plan))
    keyed = coded.select("node", "of", "code", F.size("v").alias("size"), F.posexplode("keys").alias("t", "key"))
    flagged = cut(_met(_dealt(keyed, bucket_rows)).mapInArrow(_flag(plan), "node long, of long, t int, key long").distinct())
    rows = _dealt(flagged, max(1, bucket_rows // 4)).join(coded.select("node", "code", "copies", F.size("v").alias("size"), "v"), "node")
    found = cut(_met(rows).mapInArrow(_compare(least, plan), "a long, b long, n long"))

    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    known = classes.select("node", "label", "v", "first", "copies").join(counts, "node", "left").join(roots, "node", "left")
    known = known.select("label", "v", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least_id = known.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    known = known.join(least_id, F.col("root") == F.col("r")).select(F.col("label").alias("l"), F.col("v").alias("w"), "n_links", "component_id")
    linked = fine.join(known, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", "n_links", "component_id")
    alone = vectors.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    every = linked.unionByName(alone)
    return every.select(F.col("vec_id").cast("long"), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _stored(vectors: DataFrame) -> Column:
    """Floats stay floats, which halves what moves; all arithmetic is in double precision."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    return F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
