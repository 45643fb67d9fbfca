"""Reports over transmissions and receptions: rates, per-node figures, rankings and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import stored

#: Reasons for which a reception that didn't collide still delivers nothing.
NOT_DELIVERED = ("weak_signal", "tx_busy", "already_seen")


def delivers() -> Column:
    return ~F.col("collided") & ~F.col("drop_reason").isin(*NOT_DELIVERED)


def collision_rate(rx: DataFrame) -> DataFrame:
    return rx.agg(F.coalesce(F.avg(F.col("collided").cast("int")), F.lit(0.0)).alias("rate"))


def redundant_relays(tx: DataFrame, rx: DataFrame, parts: int | None = None) -> DataFrame:
    """Relays (packet, node) of packets that reached nobody by them. With parts, both are met in so many."""
    useful = rx.where(delivers()).select("packet", F.col("from_node").alias("node")).distinct()
    dealt = lambda df: df.repartition(parts, "packet", "node") if parts else df
    return dealt(tx.where("NOT is_origin")).join(dealt(useful), ["packet", "node"], "left_anti")


def node_stats(tx: DataFrame, rx: DataFrame, parts: int | None = None) -> DataFrame:
    """node, success, collided, tx_busy, delivered, unique_deliveries, relays, redundant, airtime_ms. parts: see
    redundant_relays."""
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    heard = rx.groupBy("node").agg(count(~F.col("collided"), "success"), count(F.col("collided"), "collided"), count(F.col("drop_reason") == "tx_busy", "tx_busy"), count(delivers(), "delivered"))
    spread = rx.where(delivers()).groupBy(F.col("from_node").alias("node")).agg(F.count("*").alias("unique_deliveries"))
    sent = tx.groupBy("node").agg(count(~F.col("is_origin"), "relays"), F.sum("air_ms").alias("airtime_ms"))
    waste = redundant_relays(tx, rx, parts).groupBy("node").agg(F.count("*").alias("redundant"))
    every = heard.select("node").unionByName(spread.select("node")).unionByName(sent.select("node")).distinct()
    rows = every.join(heard, "node", "left").join(spread, "node", "left").join(sent, "node", "left").join(waste, "node", "left")
    return rows.na.fill(0)


def drop_reasons(rx: DataFrame) -> DataFrame:
    """node, reasons: how often each reason occurred, as a map."""
    counts = rx.where("drop_reason <> ''").groupBy("node", "drop_reason").count()
    return counts.groupBy("node").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("drop_reason", "count")))).alias("reasons"))


def rankings(stats: DataFrame, window_ms: int) -> DataFrame:
    """stats with duty_pct and success_rate (null where nothing was received), the busiest first."""
    duty = F.round(F.col("airtime_ms") * 100.0 / window_ms, 3)
    return stats.withColumn("duty_pct", duty).withColumn("success_rate", F.round(F.try_divide(F.col("success"), F.col("success") + F.col("collided")), 6)).orderBy(F.desc("duty_pct"), "node")


def relay_delay(tx: DataFrame, rx: DataFrame) -> DataFrame:
    """node, mean_delay_ms between the reception that made a node relay and its transmission."""
    cause = rx.where("relayed").groupBy("packet", "node").agg(F.min("at_ms").alias("at_ms"))
    rows = tx.where("NOT is_origin").join(cause, ["packet", "node"]).where("start_ms >= at_ms")
    return rows.groupBy("node").agg(F.round(F.avg(F.col("start_ms") - F.col("at_ms"))).alias("mean_delay_ms"))


def flood_time(tx: DataFrame, rx: DataFrame) -> DataFrame:
    """packet, flood_ms: from an origin's start to the last reception; 0 without receptions."""
    last = rx.groupBy("packet").agg(F.max("at_ms").alias("last_ms"))
    rows = tx.where("is_origin").groupBy("packet").agg(F.min("start_ms").alias("start_ms")).join(last, "packet", "left")
    return rows.select("packet", F.coalesce(F.col("last_ms") - F.col("start_ms"), F.lit(0)).alias("flood_ms"))


def full_stats(tx: DataFrame, rx: DataFrame, reach: DataFrame, messages: DataFrame, parts: int | None = None) -> DataFrame:
    """node_stats with contention_caused (how many collisions of others a node's transmissions had part in), reachable
    (how many of the messages could reach it) and the map of reasons. rx: also collided_with, an array of nodes; reach:
    start, id; messages: origin, background ones aren't counted."""
    caused = rx.select(F.explode("collided_with").alias("node")).groupBy("node").agg(F.count("*").alias("contention_caused"))
    sent = messages.where("NOT background").groupBy(F.col("origin").alias("start")).agg(F.count("*").alias("n"))
    aimed = reach.where("id <> start").join(sent, "start").groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("reachable"))
    rows = node_stats(tx, rx, parts).join(caused, "node", "full_outer").join(aimed, "node", "full_outer").na.fill(0)
    return rows.join(drop_reasons(rx), "node", "left")


#: The outcomes by which an inspector filters events: of transmissions, then of receptions.
SENT = (("tx", "true"), ("tx_origin", "NOT is_relay"), ("tx_relay", "is_relay"), ("relayed", "is_relay"))
HEARD = (
    ("relayed", "NOT collided AND relayed"), ("collided", "collided"), ("collided_no_lock", "collided AND collision_kind = 'no_lock'"), ("collided_corrupted", "collided AND collision_kind = 'corrupted'"),
    ("tx_busy", "NOT collided AND drop_reason = 'tx_busy'"), ("dropped", "NOT collided AND drop_reason <> '' AND drop_reason <> 'cannot_relay'"),
    ("received", "NOT collided AND NOT relayed AND drop_reason IN ('', 'cannot_relay')"),
)


def inspected(tx: DataFrame, rx: DataFrame) -> DataFrame:
    """packet, node, at_ms, kind and filters: the outcomes under which an event shows. tx: packet, node, start_ms,
    is_origin; rx: packet, node, at_ms, collided, collision_kind, relayed, drop_reason."""
    names = lambda cases: F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in cases)))
    sent = tx.withColumn("is_relay", ~F.col("is_origin")).select("packet", "node", F.col("start_ms").alias("at_ms"), F.lit("tx").alias("kind"), names(SENT).alias("filters"))
    heard = rx.withColumn("drop_reason", F.coalesce("drop_reason", F.lit(""))).select("packet", "node", "at_ms", F.lit("rx").alias("kind"), names(HEARD).alias("filters"))
    return sent.unionByName(heard)


def growth(rx: DataFrame, bucket_ms: int) -> DataFrame:
    """node, bucket, success, collided: how many receptions of each kind a node had up to the end of each time bucket."""
    per = rx.groupBy("node", F.floor(F.col("at_ms") / bucket_ms).alias("bucket")).agg(F.count(F.when(~F.col("collided"), 1)).alias("s"), F.count(F.when(F.col("collided"), 1)).alias("c"))
    so_far = W.partitionBy("node").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    return per.select("node", "bucket", F.sum("s").over(so_far).alias("success"), F.sum("c").over(so_far).alias("collided"))


def outcome(rx: DataFrame) -> DataFrame:
    """rx with its outcome, the first that fits."""
    return rx.withColumn("outcome", F.when(F.col("collided"), "collided").when(F.col("relayed"), "relayed").when(F.col("drop_reason") == "tx_busy", "tx_busy").when(F.col("drop_reason") != "", "dropped").otherwise("received"))


#: Rows of transmissions in time buckets, and pairs of them, that a task of `overlapping` meets; and pairs it hands on at once.
ROWS_PER_TASK, PAIRS_PER_TASK, PAIRS_AT_ONCE = 250_000, 32_000_000, 500_000


def _pairs(bucket_ms: int):
    """The overlapping pairs of rows that come sorted by listener, cell and start, whole buckets at a time, from each row to
    those that begin before it ends."""

    def buckets(batches):
        import pandas as pd

        held = []
        for df in batches:
            if not len(df):
                continue
            first, last = ((df["listener"] == end["listener"].iloc[k]) & (df["cell"] == end["cell"].iloc[k]) for end, k in ((held[-1] if held else df, -1), (df, -1)))
            cut = len(df) - int(last.sum())
            if held and (cut or not first.iloc[0]):
                yield pd.concat([*held, df[:cut]], ignore_index=True)
                held = []
            elif cut:
                yield df[:cut].reset_index(drop=True)
            held.append(df[cut:])
        if held:
            yield pd.concat(held, ignore_index=True)

    def met(batches):
        import numpy as np
        import pandas as pd

        for df in buckets(batches):
            listener, ids, node = df["listener"].to_numpy(), df["id"].to_numpy(), pd.factorize(df["node"])[0]
            start, end, opens = df["start_ms"].to_numpy(), df["end_ms"].to_numpy(), df["cell"].to_numpy() * bucket_ms
            unit = np.concatenate([[0], np.cumsum((listener[1:] != listener[:-1]) | (opens[1:] != opens[:-1]))])
            base, at = unit * (max(start.max(), end.max()) - start.min() + 2) - start.min(), np.arange(len(df))
            n = np.maximum(np.searchsorted(base + start, base + end) - at - 1, 0)
            so_far, lo = np.concatenate([[0], np.cumsum(n)]), 0
            while lo < len(df):
                up = max(lo + 1, int(np.searchsorted(so_far, so_far[lo] + PAIRS_AT_ONCE, "right")) - 1)
                i = np.repeat(at[lo:up], n[lo:up])
                j = i + 1 + np.arange(len(i)) - (so_far[i] - so_far[lo])
                # the later one begins in the first bucket that both touch
                real = (start[i] < end[j]) & (start[j] >= opens[i]) & (node[i] != node[j]) & (node[i] >= 0) & (node[j] >= 0) & (ids[i] != ids[j])
                i, j, lo = i[real], j[real], up
                less = ids[i] < ids[j]
                # those of one side first, then those of the other: each transmission's rows are runs in a or b, which files hold as such
                order = np.concatenate([np.flatnonzero(less), np.flatnonzero(~less)])
                i, j, less = i[order], j[order], less[order]
                yield pd.DataFrame({"listener": listener[i], "a": np.where(less, ids[i], ids[j]), "b": np.where(less, ids[j], ids[i]), "overlap_ms": np.minimum(end[i], end[j]) - start[j]})

    return met


def overlapping(heard: DataFrame, bucket_ms: int) -> DataFrame:
    """listener, a, b, overlap_ms: transmissions (id, node, start_ms, air_ms) of different nodes that are on air at once
    where a listener can hear both, each pair once for each listener. heard: a row per transmission and listener, with
    whole milliseconds.
    An interval is put into every time bucket it touches, and a pair counts in the first that both touch. Buckets are dealt
    into tasks by their rows and by the pairs that these can make; there they are sorted, and only pairs that overlap are
    made, some at a time. A bucket of one listener is held whole."""
    timed = heard.where("listener IS NOT NULL AND id IS NOT NULL AND start_ms IS NOT NULL AND air_ms IS NOT NULL")
    timed = stored(timed.select("listener", "id", "node", F.col("start_ms").cast("long").alias("start_ms"), (F.col("start_ms") + F.col("air_ms")).cast("long").alias("end_ms")), "on-air")
    cell = lambda c: F.floor(F.col(c) / bucket_ms)
    spread = timed.select("*", F.explode(F.sequence(cell("start_ms"), cell("end_ms"))).alias("cell"))
    rows, pairs = spread.groupBy("listener", "cell").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n") / 2), F.lit(0.0))).first()
    tasks = max(-(-rows // ROWS_PER_TASK), int(pairs // PAIRS_PER_TASK) + 1, heard.sparkSession.sparkContext.defaultParallelism)
    kind = lambda c: timed.schema[c].dataType.simpleString()
    dealt = spread.repartition(tasks, "listener", "cell").sortWithinPartitions("listener", "cell", "start_ms")
    return dealt.mapInPandas(_pairs(bucket_ms), f"listener {kind('listener')}, a {kind('id')}, b {kind('id')}, overlap_ms long")


#: Rows of transmissions at listeners that are met together in memory; a time bucket of a listener stays whole.
MET_TOGETHER = 50_000
#: Such groups in a task, where there are many.
GROUPS_PER_TASK = 8


def _met(bucket_ms: int):
    """Of each row of whole time buckets: how many others of other nodes overlap it, in the first bucket that both touch, their
    summed power, and the greatest snr of those that begin before its lock_ms. Counts and powers are differences of running
    sums, powers as exact integers in limbs of 24 bits; greatest values come from tables of ranges of 2^k, which hold the
    best two of different nodes, so that a node's own can be left out."""

    def met(df):
        import numpy as np
        import pandas as pd

        node, names = pd.factorize(df["node"])
        unit = df.groupby(["listener", "cell"]).ngroup().to_numpy()
        start, end, opens = df["start_ms"].to_numpy(), df["end_ms"].to_numpy(), df["cell"].to_numpy() * bucket_ms
        home, sends, n = start >= opens, node >= 0, len(df)
        first = min(start.min(), opens.min())
        wide = 2 * (max(end.max(), opens.max()) - first) + 4
        key = lambda t: unit * wide + 2 * (t - first) + 1  # noqa: E731  # units behind each other on one axis; odd, so that there is room between
        nil = (start == end).astype(np.int64)
        keys, ranks = np.unique(np.concatenate([key(start), key(end) + nil, key(start) + 1 - nil, key(end), key(opens)]), return_inverse=True)
        begun, ended, before, until, since = ranks.reshape(5, n)

        def overlapped(group):
            base = group * np.int64(len(keys) + 1)
            by_start, by_end = np.argsort(base + begun), np.argsort(base + ended)
            starts, ends = (base + begun)[by_start], (base + ended)[by_end]
            hi, over, earlier = np.searchsorted(starts, base + until), np.searchsorted(ends, base + before, "right"), np.searchsorted(starts, base + since)

            def of(v):
                a, b = (np.concatenate([[0], np.cumsum(v[o])]) for o in (by_start, by_end))
                return a[hi] - np.where(home, b[over], a[earlier])

            return of

        every, own = overlapped(np.zeros(n, np.int64)), overlapped(node + 1)
        others = lambda v: np.where(sends, every(v) - own(v), 0)
        snr = df["snr"].to_numpy(np.float64)
        counts = sends & ~np.isnan(snr)
        with np.errstate(over="ignore"):
            power = np.where(counts, np.power(10.0, np.where(counts, snr, 0.0) / 10), 0.0)
        endless = np.isinf(power)
        part, exponent = np.frexp(np.where(endless, 0.0, power))
        digits, exponent = np.ldexp(part, 53).astype(np.int64), exponent.astype(np.int64) - 53
        least = exponent[digits > 0].min(initial=0) if (digits > 0).any() else 0
        shift, mask = np.where(digits > 0, exponent - least, 0), np.int64((1 << 24) - 1)
        total, carry, limbs = np.zeros(n), np.zeros(n, np.int64), -(-(53 + int(shift.max())) // 24)
        for k in range(limbs):
            off = 24 * k - shift
            limb = np.where(off >= 0, (digits >> np.clip(off, 0, 62)) & mask, ((digits & mask) << np.clip(-off, 0, 24)) & mask)
            d = others(limb) + carry
            carry = d >> 24
            total += np.ldexp((d & mask).astype(np.float64), 24 * k + int(least))
        total += np.ldexp(carry.astype(np.float64), 24 * limbs + int(least))
        total = np.where(others(endless.astype(np.int64)) > 0, np.inf, total)

        values, rank = np.unique(np.where(counts, snr, 0.0), return_inverse=True)
        many = np.int64(len(names) + 1)
        code = np.where(counts, rank * many + node, -1)

        def best(a, a2, b, b2):
            top, low = np.maximum(a, b), np.minimum(a, b)
            other = lambda c: np.where((c >= 0) & (c % many != top % many), c, -1)
            return top, np.maximum(other(low), np.maximum(other(a2), other(b2)))

        none = np.full(n, -1, np.int64)
        level = lambda count: np.frexp(np.maximum(count, 1).astype(np.float64))[1] - 1
        # those that begin from its start, or from the bucket's, to its lock
        lock = df["lock_ms"].to_numpy(np.float64)
        limit = np.clip(np.where(np.isnan(lock), start, lock), start, end).astype(np.int64)
        order = np.argsort(key(start) - nil)
        starts = (key(start) - nil)[order]
        lo, hi = np.searchsorted(starts, np.where(home, key(start), key(opens) - 1)), np.searchsorted(starts, key(limit) - 1)
        at, one, two = level(hi - lo), none.copy(), none.copy()
        t, t2 = code[order], none.copy()
        for k in range(int(at.max()) + 1):
            q = np.flatnonzero((at == k) & (hi > lo))
            one[q], two[q] = best(t[lo[q]], t2[lo[q]], t[hi[q] - (1 << k)], t2[hi[q] - (1 << k)])
            h = 1 << k
            if len(t) <= h:
                break
            t, t2 = best(t[:-h], t2[:-h], t[h:], t2[h:])
        # those on air at its start
        points = np.unique(key(start)[home])
        left, right = np.searchsorted(points, key(start), "right"), np.searchsorted(points, key(end))
        at = np.where((right > left) & counts, level(right - left), -1)
        t = t2 = np.full(len(points), -1, np.int64)
        for k in range(int(at.max()), -1, -1):
            u, u2 = np.full(len(points), -1, np.int64), np.full(len(points), -1, np.int64)
            q = np.flatnonzero(at == k)
            where, what = np.concatenate([left[q], right[q] - (1 << k)]), np.concatenate([code[q], code[q]])
            np.maximum.at(u, where, what)
            differ = what % many != u[where] % many
            np.maximum.at(u2, where[differ], what[differ])
            t, t2 = best(t, t2, u, u2)
            if k:  # what holds for 2^k points holds for both halves
                h = 1 << (k - 1)
                s, s2 = (np.concatenate([np.full(min(h, len(x)), -1, np.int64), x[:-h]]) for x in (t, t2))
                t, t2 = best(t, t2, s, s2)
        if len(points):
            p = np.clip(np.searchsorted(points, key(start)), 0, len(points) - 1)
            one, two = best(one, two, np.where(home, t[p], -1), np.where(home, t2[p], -1))
        got = np.where(one % many != node, one, two)
        got = np.where(sends & ~np.isnan(lock), got, -1)
        early = np.where(got >= 0, values[np.maximum(got, 0) // many], np.nan)
        return pd.DataFrame({"listener": df["listener"], "id": df["id"], "snr": snr, "early": early, "power": total, "n": others(sends.astype(np.int64))})

    return met


def capture_outcomes(heard: DataFrame, bucket_ms: int, lock_db: float = 6.0, payload_db: float = 6.0) -> DataFrame:
    """listener, id, outcome, interferers of each transmission at each listener: no_lock if one that begins before the end
    of its preamble is less than lock_db weaker; else corrupted if the summed power of all that overlap it is less than
    payload_db weaker; else captured. heard: listener, id, node, start_ms, air_ms, preamble_ms, snr, a row per transmission
    and listener, with whole milliseconds (start_ms, air_ms); a node doesn't interfere with itself, and no snr or NaN has no
    power. Margins hold up to rounding.

    As in `overlapping`, intervals meet in the first time bucket that both touch. Those of a bucket are sorted, not paired: so
    the work grows with the transmissions by a logarithm, however many are on air at once. Buckets are dealt to groups of
    about MET_TOGETHER rows."""
    timed = stored(heard.where("listener IS NOT NULL").select("listener", "id", "node", F.col("start_ms").cast("long").alias("start_ms"), (F.col("start_ms") + F.col("air_ms")).cast("long").alias("end_ms"), (F.col("start_ms") + F.floor("preamble_ms")).cast("double").alias("lock_ms"), F.col("snr").cast("double").alias("snr")), "heard")
    cell = lambda c: F.floor(F.col(c) / bucket_ms)
    parts = -(-timed.count() // MET_TOGETHER) or 1
    spread = timed.select("*", F.explode(F.sequence(cell("start_ms"), cell("end_ms"))).alias("cell"))
    spread = spread.withColumn("_part", F.pmod(F.xxhash64("listener", "cell"), F.lit(parts)))
    tasks = -(-parts // GROUPS_PER_TASK)  # grow in number, not in size
    dealt = lambda df, *by: df.repartition(tasks, *by) if tasks > int(heard.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
    kind = lambda c: timed.schema[c].dataType.simpleString()
    met = dealt(spread, "_part").groupBy("_part").applyInPandas(_met(bucket_ms), f"listener {kind('listener')}, id {kind('id')}, snr double, early double, power double, n long")
    sums = dealt(met, "listener", "id").groupBy("listener", "id", "snr").agg(F.max("early").alias("early"), F.sum("power").alias("power"), F.sum("n").alias("interferers"))
    outcome = F.when(F.col("snr") - F.col("early") < lock_db - 1e-9, "no_lock").when(F.col("snr") - 10 * F.log10("power") < payload_db - 1e-9, "corrupted").otherwise("captured")
    return sums.select("listener", "id", outcome.alias("outcome"), "interferers")


#: What a node's figures say, with its weight: name, condition over its columns, weight.
FINDINGS = (
    ("loop_detect_drops", "loop_detect > 0", 90), ("hop_limit_drops", "hop_limit > 0", 80), ("region_mismatch_drops", "region_mismatch > 0", 80), ("cannot_relay", "cannot_relay > 0", 10),
    ("weak_signal", "weak_signal > 0", 60), ("tx_busy_misses", "tx_busy > 0", 70), ("own_receptions_collided", "collided > 0", 50), ("causes_contention", "contention > 0", 85),
    ("redundant_relays", "redundant > 0", 75), ("high_duty_cycle", "airtime_ms * 100.0 / {window} >= 40", 65),
)


def diagnoses(stats: DataFrame, window_ms: int) -> DataFrame:
    """node, findings: the names of what was found, the weightiest first, of equals in the order of FINDINGS.
    stats: the columns of node_stats, contention, and a column for each drop reason."""
    found = F.array_compact(F.array(*(F.when(F.expr(c.format(window=window_ms)), F.struct(F.lit(-w).alias("w"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, c, w) in enumerate(FINDINGS))))
    return stats.select("node", F.array_join(F.transform(F.sort_array(found), lambda x: x["n"]), ",").alias("findings"))


def headlines(stats: DataFrame, window_ms: int) -> DataFrame:
    """node, headline: what matters most about a node. relayed_none if it received packets, relayed none and isn't kept
    from relaying; else its weightiest finding; else received_nothing, or healthy. stats: as for diagnoses."""
    received = F.col("success") + F.col("collided")
    found = diagnoses(stats, window_ms).select("node", F.split("findings", ",")[0].alias("first"))
    rows = stats.select("node", "relays", "cannot_relay", received.alias("received")).join(found, "node")
    case = F.when((F.col("received") > 0) & (F.col("relays") == 0) & (F.col("cannot_relay") == 0), "relayed_none").when(F.col("first") != "", F.col("first")).when(F.col("received") == 0, "received_nothing").otherwise("healthy")
    return rows.select("node", case.alias("headline"))


def contention_score(weights: tuple[float, float, float, float]) -> Column:
    return sum((F.col(c) * w for c, w in zip(("contention", "collided", "redundant", "duty_pct"), weights, strict=True)), F.lit(0.0))


def ranked_contention(stats: DataFrame, weights: tuple[float, float, float, float], keep: int) -> DataFrame:
    """node, score, reason, rank of the nodes of highest score; of equals the lesser node."""
    scored = stats.select("node", contention_score(weights).alias("score"), main_reason(weights).alias("reason")).orderBy(F.desc("score"), "node").limit(keep)
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "node")))  # `keep` rows


def main_reason(weights: tuple[float, float, float, float]) -> Column:
    """The name of the greatest part of the score; of equals the first."""
    parts = {c: F.col(c) * w for c, w in zip(("contention", "collided", "redundant", "duty_pct"), weights, strict=True)}
    most, out = F.greatest(*parts.values()), None
    for name, part in parts.items():
        out = F.when(part == most, name) if out is None else out.when(part == most, name)
    return out


def knee(levels: DataFrame, share: float = 0.95) -> DataFrame:
    """The last level (level, delivery) whose delivery is at least a share of the first level's."""
    first = levels.agg(F.min_by("delivery", "level").alias("base"))
    return levels.join(F.broadcast(first)).where(F.col("delivery") >= share * F.col("base")).agg(F.max("level").alias("knee"))


def paired_differences(a: DataFrame, b: DataFrame, z: float) -> DataFrame:
    """n, mean, sd and the bounds of the differences between paired trials (trial, value)."""
    d = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), "trial").select((F.col("y") - F.col("x")).alias("d"))
    m = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    half = z * F.col("sd") / F.sqrt("n")
    return m.select("n", "mean", "sd", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))
