"""The registered queries against SQL or plain brute force, on the driver's smallest tables."""

import os
import re
import zlib

import checking
import numpy as np
import pytest

from wavemesh.llm import decontamination, flat_graph, ngram_join, pii, shared, tokens, toxicity
from wavemesh.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return checking.connected(SF)


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    checking.same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def groups(ids, linked):
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    return {i: root(i) for i in ids}


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c < "\x7f" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(spark, docs):
    sets = {i: plain_shingles(t) for i, t, _ in docs}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op1_ngram_join"](spark, SF).collect()}
    assert links and got == {i: (len(s), want[i]) for i, s in sets.items()}


@pytest.mark.parametrize("edits", [4, 9, 14, 25])
def test_ngram_join_of_a_hot_group(spark, edits):
    """Many near copies of one text, of one another similar or just not, over many frequent shingles."""
    rnd = np.random.default_rng(edits)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(150):
        w = list(words)
        for j in rnd.choice(120, rnd.integers(0, edits) // 4, replace=False):
            w[j] = f"x{k}y{j}"
        texts.append(" ".join(w[: 120 - int(rnd.integers(0, edits))]))
    sets = [plain_shingles(t) for t in texts]
    want = groups(range(150), [(a, b) for a in range(150) for b in range(a + 1, 150) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(df).collect()} == want


def test_links_come_out_of_opened_blocks(spark, monkeypatch):
    """Near copies link through the matrix alone, and blocks behind the leader's are needed."""
    base = [f"w{i}" for i in range(100)]
    # each a little further from the first than the one before: neighbours link, far ones don't
    texts = [" ".join([f"x{j}" for j in range(3 * k)] + base[: 100 - 3 * k]) for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [plain_shingles(t) for t in texts]
    want = groups(range(12), [(a, b) for a in range(12) for b in range(a + 1, 12) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    found = lambda: {r.doc_id: r.component_id for r in ngram_join.join(df).collect()}
    assert set(want.values()) == {0} and found() == want
    whole, calls = ngram_join.opened, []

    def leaders_only(*args):
        calls.append(args)
        links = whole(*args)
        return links if len(calls) == 1 else links.where("false")

    monkeypatch.setattr(ngram_join, "opened", leaders_only)
    assert len(set(found().values())) > 1 and len(calls) == 2
    monkeypatch.setattr(ngram_join, "opened", lambda *args: whole(*args).where("false"))
    assert found() == {i: i for i in range(12)}


def test_bounds_of_a_block_lose_no_link():
    rnd = np.random.default_rng(1)
    shut = links = 0
    for _ in range(60):
        base = rnd.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate((base[rnd.random(60) < 0.93], rnd.integers(0, 2**63, rnd.integers(0, 8), dtype=np.uint64)))) for _ in range(10)]
        sets.append(np.unique(np.concatenate((base[:30], rnd.integers(0, 2**63, 30, dtype=np.uint64)))))
        frequent = np.unique((base[rnd.random(60) < 0.4] >> np.uint64(2)) & np.uint64(0xFFFFFFFF))
        heads = [ngram_join.prefix(s, frequent) for s in sets]
        block = ngram_join.Block(np.arange(5), np.array([len(s) for s in sets[:5]]), heads[:5])
        for i, (s, head) in enumerate(zip(sets, heads, strict=True)):
            near = {k for k in range(5) if k != i and ngram_join.linked(s, sets[k])}
            links += len(near)
            may = set(block.may_link(i, len(s), head))
            assert near <= may and (not near or block.opens(len(s), head)) and all(shared.overlap(head, heads[k]) for k in near)
            shut += not block.opens(len(s), head)
    assert shut and links


def test_toxicity_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert toxicity._area(np.array([rows[i].score for i, _ in labels]), np.array([y for _, y in labels])) > 0.85


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rnd = np.random.default_rng(2)
    for _ in range(500):
        p, t = ("".join(rnd.choice(list("abc "), rnd.integers(lo, 40))) for lo in (1, 0))
        assert decontamination.Pattern(0, p).distance(t) == least_distance(p, t)


def test_decontamination(spark, con, docs):
    items = [decontamination.Pattern(i, decontamination.normal(t)) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = {}
    for i, t, _ in docs:
        text = decontamination.normal(t)
        # whole items, and by brute force in every fourth document that is short
        hits = {p.item_id: 0 for p in items if p.text and f" {p.text} " in f" {text} "}
        want[i] = hits
    got = {r.doc_id: dict(tuple(map(int, x.split(":"))) for x in r["items"].split(",") if x) for r in QUERIES["op3_decontamination"](spark, SF).collect()}
    for i, hits in want.items():
        assert hits.items() <= got[i].items()
        text = decontamination.normal(dict((a, b) for a, b, _ in docs)[i])
        for item, d in got[i].items():
            p = next(p for p in items if p.item_id == item)
            assert d <= p.k and d >= least_distance(p.text, text) if len(text) < 3000 else d <= p.k


def test_decontamination_equals_brute_force():
    """Substitutions, insertions and deletions, within the budget and beyond: what is found is all and only what the
    least edit distance to any part of the text allows."""
    rnd = np.random.default_rng(3)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), rnd.integers(2, 9)))
    items = [(i, decontamination.normal(" ".join(word() for _ in range(n)))) for i, n in enumerate((3, 4, 5, 8, 12, 20, 30))]
    finder, found, missed = decontamination.Finder(items), 0, 0
    for round_ in range(150):
        i, t = items[rnd.integers(len(items))]
        chars = list(t)
        for _ in range(rnd.integers(0, 2 * int(decontamination.RATE * len(t)) + 2)):
            at = int(rnd.integers(1, len(chars) - 1))
            how = rnd.integers(3)
            if how == 0:
                chars[at] = "z"
            elif how == 1:
                chars.insert(at, "z")
            else:
                del chars[at]
        text = " ".join([word(), word(), "".join(chars), word()])
        got = dict(finder.finds(text))
        for j, item in items:
            k = int(decontamination.RATE * len(item))
            d = least_distance(item, f" {decontamination.normal(text)} ")
            if k == 0:
                assert (j in got) == (f" {item} " in f" {decontamination.normal(text)} ")
            else:
                assert (j in got) == (d <= k) and (j not in got or d <= got[j] <= k), (round_, j)
            found += j in got
            missed += j == i and j not in got
    assert found > 50 and missed > 20


def test_tokens(spark, docs):
    pieces = tokens.load_pieces() if os.path.exists(tokens.VOCABULARY) else {"▁": -3.0, "e": -2.0, "th": -4.0, "▁the": -3.5}
    byte = min(pieces.values()) - 10

    def plain(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            best.append(min([(best[i - 1][0] - n * byte, best[i - 1][1] + n), *((best[j][0] - pieces[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in pieces)]))
        return best[-1][1]

    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.count_tokens(df, pieces).collect()}
    for i, t, _ in docs[:40]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert got[i] == (len(words), sum(plain(tokens.SPACE + w) for w in words))


@pytest.mark.parametrize("spread", [0.02, 0.035, 0.05])
def test_embeddings(spark, spread):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(1500, 32))
    for k in range(0, 1200, 60):  # clusters around some of them
        x[k : k + 60] = x[k] / np.linalg.norm(x[k]) + rnd.normal(size=(60, 32)) * spread
    x[1300:1400] = x[1299]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, recall = flat_graph.near_duplicates(df)
    rows = {r.vec_id: r for r in got.collect()}
    u = flat_graph.unit(x.tolist())
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    found = np.array([rows[i].n_links for i in range(1500)])
    assert recall >= 0.9 and (found <= hit.sum(1)).all() and found.sum() >= 0.9 * hit.sum()
    comps = groups(range(1500), zip(*np.nonzero(hit), strict=True))
    assert sum(rows[i].component_id == comps[i] for i in range(1500)) >= 0.95 * 1500


def test_search_goes_on_from_the_query_itself():
    turn = lambda a: [np.cos(a), np.sin(a)]
    x = np.array([turn(0.0), turn(0.6), turn(0.2)])  # the second is out of range and leads to the third
    edges = [np.array([1]), np.array([0, 2]), np.array([1])]
    assert set(flat_graph.search(x[0], x, edges, np.array([0]), 0)) == {0, 2}


def test_recall_is_a_mean_over_vectors():
    assert flat_graph.mean_recall({1: 10_000, 2: 1, 3: 1, 4: 1}, {1: 10_000}) == 0.25


@pytest.mark.parametrize("linked", [2, 40, 600])
def test_embeddings_when_the_graph_finds_nothing(spark, monkeypatch, linked):
    monkeypatch.setattr(flat_graph, "found_links", lambda nodes, c, overlap: nodes.selectExpr("node", "0L AS links", "node AS root"))
    for name, value in (("SAMPLE", 300), ("BLOCK", 250), ("ROWS", 64)):
        monkeypatch.setattr(flat_graph, name, value)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(900, 24))
    for i in range(1, linked):  # a chain whose ends aren't similar
        x[i] = x[i - 1] / np.linalg.norm(x[i - 1]) + rnd.normal(size=24) * 0.04
    x[700:705] = x[0]
    x = x[rnd.permutation(900)]
    got, recall = flat_graph.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    u = flat_graph.unit(x.tolist())
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    comps = groups(range(900), zip(*np.nonzero(hit), strict=True))
    assert recall == 1.0 and {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {i: (int(hit[i].sum()), comps[i]) for i in range(900)}


def test_pii(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op10_pii"](spark, SF).collect()}
    for i, t, _ in docs:
        spans = got[i].spans.split(",") if got[i].spans else []
        want = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.plain_spans(t)]
        assert set(want) <= set(spans) and len(spans) == sum(got[i][f"n_{k}"] for k in pii.KINDS)


def test_pii_digests_and_mapped_spans(spark):
    """base_sha256 from the patterns as the contract words them, and disguised spans cut from the source text."""
    import hashlib

    texts = ["", "a@b.co, 10.0.0.1", "call +1 (217) 555-0134 or 4111 1111 1111 1111", "ann [аt] x (dоt) org", "ann [at] b.co dot uk", "one two three dot four five dot six dot seven", "1.2.3.4.5 300.1.1.1 x@y", "é é a.b@c-d.e.f é +49 30 1234567", None]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda t: re.sub("[^0-9]", "", t)
    checks = {"email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")), "card": lambda t: 12 <= len(digits(t)) <= 19 and pii.luhn(digits(t)), "phone": lambda t: 9 <= len(digits(t)) <= 15}
    (docs_dir := shared.stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "pii-docs")).count()
    found = pii.detect(docs_dir)
    rows = {r.doc_id: r.spans for r in found.collect()}
    for i, t in enumerate(texts):
        base = sorted((m.start(), list(patterns).index(k), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, t or "") if checks[k](m[0]))
        assert [(s.kind, s.start, s.end) for s in rows[i] if s.base] == [(k, a, b) for a, _, b, k in base]
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest() == hashlib.sha256(",".join(f"{s.kind}:{s.start}:{s.end}" for s in rows[i] if s.base).encode()).hexdigest()
    cut = lambda i: [texts[i][s.start : s.end] for s in rows[i] if not s.base]
    assert cut(3) == [texts[3]] and cut(4) == [texts[4]] and cut(5) == [texts[5]]


@pytest.mark.parametrize(("text", "want"), [
    ("pay four 111 1111 1111 1111 now", ["card four 111 1111 1111 1111"]),
    ("pay 4111 one 111 1111 1111 now", ["card 4111 one 111 1111 1111"]),
    ("write john_at_example_dot_com today", ["email john_at_example_dot_com"]),
    ("write j_dot_roe_at_mail_dot_example_dot_org today", ["email j_dot_roe_at_mail_dot_example_dot_org"]),
    ("to ann\u200b@\u200bex\u00adample.com.", ["email ann\u200b@\u200bex\u00adample.com"]),
    ("host 2l7.1O.0.1 is down", ["ip 2l7.1O.0.1"]),
    ("host ten one.two.3.four is down", ["ip one.two.3.four"]),
    ("call +1 2I7 555 o134 today", ["phone +1 2I7 555 o134"]),
    ("look_at_me and the_dot_com boom, I 2 am one of 3 lo", []),
    ("meet_at_noon, no_dot_here 10.0.0.1 O", ["ip 10.0.0.1"]),
])
def test_pii_disguises(text, want):
    assert [f"{pii.KINDS[k]} {text[a:b]}" for a, k, b, _ in pii.spans(text)] == want


def test_pii_of_random_texts_and_long_runs():
    """Plain finds are the contract's, whatever is rewritten; mapped spans lie in the text; scans are linear."""
    import random
    import time

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    size = lambda t: len(re.sub("[^0-9]", "", t))
    checks = {"email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")), "card": lambda t: 12 <= size(t) <= 19 and pii.luhn(re.sub("[^0-9]", "", t)), "phone": lambda t: 9 <= size(t) <= 15}
    draw = random.Random(7)
    parts = ["one", "four", " ", " ", ".", "-", "l", "O", "o", "1", "41", "111", "0", "_at_", "_dot_", "@", " at ", " dot ", "a", "x.co", "+", "\u200b", "а", "(", "[at]", "1111 1111 1111"]
    for _ in range(20_000):
        text = "".join(draw.choices(parts, k=draw.randrange(25)))
        found = pii.spans(text)
        base = sorted((m.start(), list(patterns).index(k), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if checks[k](m[0]))
        assert [f[:3] for f in found if f[3]] == base and all(0 <= a < b <= len(text) for a, _, b, _ in found)
    began = time.process_time()
    for run in ("1 ", "l.", "one ", "one.1 ", "a_at_", "a_dot_", "a_at_b_dot_", "1 1a ", "\u200b", "O"):
        pii.spans(run * 200_000)
    assert time.process_time() - began < 60


def test_pipeline(spark, docs):
    import corpus_pipeline

    stages, before = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stages[name] = (before, stage(spark, before, SF))
        before = shared.stored(stages[name][1], f"test-{name}")
        assert name == "sharding" or tuple(before.columns) == corpus_pipeline.COLUMNS
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    start, kept = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", shared.F.col("toxic").alias("label")).where(~toxicity.held_out(shared.F.col("doc_id")))
    scored = {r.doc_id: r.score for r in toxicity.score(start, toxicity.fit(start, labels)).collect()}
    assert ids(kept) == {i for i, x in scored.items() if x < toxicity.REJECT_FROM}
    start, kept = stages["ngram_join"]
    sets = {r.doc_id: plain_shingles(r.text) for r in start.collect()}
    comps = groups(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert ids(kept) == {i for i, c in comps.items() if i == c}
    start, kept = stages["decontamination"]
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in start.collect() if any(f" {i} " in f" {decontamination.normal(r.text)} " for i in items)}
    assert holds and not holds & ids(kept) and len(ids(start)) - len(ids(kept)) == len(holds)
    from wavemesh.llm import sharding

    table, last = sharding.lookup_table(), before.collect()
    assert len(last) == stages["mixing"][1].count() and all(r.shard == table[r.slot] for r in last)


def test_mixing_by_brute_force(spark, docs):
    """The queue sorted whole in plain Python: another sort key, or another place of the cut, shows."""
    import hashlib

    from wavemesh.llm import mixing

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs})
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    want_by_row, entries = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    target = {r.doc_id: r.target for r in want_by_row.collect()}
    queue = []
    for s in sources:
        begin = 0
        for _, i in sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i) for i, _, x in docs if x == s):
            queue += [((begin + e * total[s] + size[i]) / target[i], s, begin + e * total[s], i, e) for e in (0, 1) if size[i]]
            begin += size[i]
    left, at, want = int(1.5 * sum(total.values())), 0, []
    for finish, _, _, i, e in sorted(queue):
        if (took := min(size[i], left - at)) > 0:
            want.append((i, e, finish, took, at))
        at += size[i]
    got = [(r.doc_id, r.epoch, r.virtual_finish, r.taken, r.position) for r in entries.orderBy("position").collect()]
    assert got == want


def test_lookup_table_is_filled_by_turns():
    import hashlib

    from wavemesh.llm import sharding

    size, shards = 101, ("a", "b", "c")
    owner = {}
    orders = []
    for s in shards:
        offset, step = (int(hashlib.md5(f"{kind}:{s}".encode()).hexdigest()[:15], 16) for kind in ("offset", "step"))
        orders.append([(offset % size + k * (step % (size - 1) + 1)) % size for k in range(size)])
    assert all(sorted(o) == list(range(size)) for o in orders)
    while len(owner) < size:
        for i, order in enumerate(orders):
            free = [x for x in order if x not in owner]
            if free:
                owner[free[0]] = i
    assert sharding.lookup_table(shards, size) == [owner[x] for x in range(size)]


def test_pipeline_mixes_as_the_operator_does(spark, monkeypatch):
    from collections import Counter

    import corpus_pipeline
    from wavemesh.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id % 9 = 0").withColumn("source", docs["source"].substr(9, 1)).withColumn("doc_id", docs["doc_id"] + 1000))
    got = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())
    assert got == Counter(r.doc_id for r in mixing.mix(docs)[1].collect()) and max(got.values()) == 2
    monkeypatch.setattr(corpus_pipeline, "MOST_CUTS", 1)
    assert got == Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect())


def test_ids_are_joined_alike_broadcast_or_not(spark, monkeypatch):
    rows, ids = spark.range(50).withColumnRenamed("id", "doc_id"), spark.range(0, 80, 3).withColumnRenamed("id", "doc_id")
    few = {h: sorted(r.doc_id for r in shared.by_ids(rows, ids, h).collect()) for h in ("left_semi", "left_anti")}
    monkeypatch.setattr(shared, "BROADCAST_IDS", 3)
    assert few == {h: sorted(r.doc_id for r in shared.by_ids(rows, ids, h).collect()) for h in few}


def test_links_are_counted_at_both_ends(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "PER_CENTROID", 120)
    monkeypatch.setattr(flat_graph, "PART", 150)
    rng = np.random.default_rng(31)
    middle = rng.normal(size=(300, 32))
    x = np.repeat(middle, 8, axis=0) + rng.normal(size=(2400, 32)) * 0.22
    x[500:540] = x[499]
    u = flat_graph.unit(x.tolist())
    hit = u @ u.T >= flat_graph.SIMILAR
    np.fill_diagonal(hit, False)
    got, _ = flat_graph.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    links = np.array([r.n_links for r in got.orderBy("vec_id").collect()])
    want = hit.sum(1)
    assert want.sum() > 4000 and (want > 0).mean() < 0.96
    assert links.sum() % 2 == 0 and links.sum() >= 0.98 * want.sum()
    # what is counted at one end is counted at the other: a vector can only lack links to ones that lack as many
    lacks = want - links
    assert (lacks >= 0).all() and all(lacks[np.flatnonzero(hit[i])].sum() >= lacks[i] for i in np.flatnonzero(lacks))


def test_the_audit_ends(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "AUDITED", 10)
    monkeypatch.setattr(flat_graph, "MOST_DRAWN", 75)
    x = flat_graph.unit(np.random.default_rng(1).normal(size=(300, 16)).tolist())
    nodes = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "node long, vector array<double>, copies long")
    assert flat_graph.audited(nodes, np.arange(300), x) == ({}, 75)
    assert flat_graph.least_recall({}, {}) == 0 and 0.9 < flat_graph.least_recall(dict.fromkeys(range(200), 3), dict.fromkeys(range(200), 3)) < 1
