"""Shards, lines, URLs, grades and mixes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lontar.llm import lines, mixing, quality, sharding, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, rule string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, None, s, None, "x", "y", "z") for d, t, s in rows], DOCS)


EDGES = [(1, None, "a"), (2, "", "a"), (None, "some words here", None), (3, "w " * 50_000, "b"), (4, "same", "b"), (4, "same", "b"), (5, "é ü", None)]


# ------------------------------------------------------------ shards


def test_shards(spark, tmp_path):
    rows = EDGES + [(100 + i, "x" * (i % 97), "c") for i in range(2000)]
    got = sharding.shard_documents(docs(spark, rows), 10, 256, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values())
    stored = sharding.SlotMap.load(spark, str(tmp_path))
    assert stored.version == 1 and all(stored.owner[r.vslot] == r.shard for r in got)
    assert sharding.shard_documents(docs(spark, [])).collect() == []


def test_shards_move_little_when_more_comes(spark, tmp_path):
    rows = [(i, "x" * (i * 7 % 97), "c") for i in range(3000)]
    before = {r.vslot: r.shard for r in sharding.shard_documents(docs(spark, rows), 10, 256, str(tmp_path)).collect()}
    after = {r.vslot: r.shard for r in sharding.shard_documents(docs(spark, rows + [(9000 + i, "y" * 50, "c") for i in range(300)]), 10, 256, str(tmp_path)).collect()}
    assert sharding.SlotMap.latest(spark, str(tmp_path)).version == 2
    assert sum(after[s] != o for s, o in before.items()) <= 40


def test_the_query_edits_the_stored_map(spark, tmp_path):
    """A second run on more rows loads the version that the first one stored, and few slots move."""
    def run(n, mode):
        docs(spark, [(i, "x" * (i * 7 % 97), "c") for i in range(n)]).write.mode(mode).parquet(f"{tmp_path}/documents.parquet")
        return sharding.op5_slots(spark, str(tmp_path)).collect()

    first, second = run(20_000, "error"), run(22_000, "overwrite")
    before, after = ({r.vslot: r.shard for r in rows} for rows in (first, second))
    assert sum(after[s] != o for s, o in before.items() if s in after) < 0.2 * len(before)
    load = Counter()
    for r in second:
        load[r.shard] += r.size
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= 113
    sparse = sharding.SlotMap(0, 40, (0, 1, 2))  # most shards hold nothing
    sparse.save(spark, str(tmp_path / "m"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "m")) == sparse


def test_shards_query(spark, sf):
    """Law `bytes` at 40 shards over whole tables; repeated rows are spread."""
    got = sharding.op5_slots(spark, "/root/testdata/sf0.01").collect()
    want = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in want)
    load, by = Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        by[r.shard].append(r.slot)
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= max(r.size for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    same = sharding.shard_documents(docs(spark, [(1, "same text", "a")] * 4000)).collect()
    sizes = Counter(r.shard for r in same)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2


def test_rebalancing_evens_out_and_moves_little():
    rng = np.random.default_rng(1)
    sizes = {s: int(x) for s, x in enumerate(rng.lognormal(3, 1, 4096))}
    first = sharding.SlotMap.initial(4096, 40)
    even = first.rebalanced(sizes)
    load = Counter()
    for s, o in enumerate(even.owner):
        load[o] += sizes[s]
    assert max(load.values()) - min(load.values()) <= 2 and len(load) == 40
    assert sum(a != b for a, b in zip(first.owner, even.owner, strict=True)) < 1600
    again = even.rebalanced(sizes)
    assert sum(a != b for a, b in zip(even.owner, again.owner, strict=True)) <= 80
    grown = even.grown(41)
    assert all(b in (a, 40) for a, b in zip(even.owner, grown.owner, strict=True)) and 90 <= sum(b == 40 for b in grown.owner) <= 110


# ------------------------------------------------------------ lines


def brute_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(-(2**63) if d is None else d)
    out = []
    for d, t, _ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(holders[key(x)]) < 5 or max(holders[key(x)]) == (-(2**63) if d is None else d)]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines(spark):
    common, rare = "A line that many documents share, long enough to count.", "A line that only four documents share, long enough."
    rows = [(i, f"own {i}\n{common.upper() if i % 2 else '  ' + common}\t\n{common}\n\nshort", "a") for i in range(8)]
    rows += [(10 + i, rare, "a") for i in range(4)] + [(3, f"second text of 3\n{common}", "a"), (None, common, None), (20, common + "\r", "a"), (21, "K" + common, "a"), (22, common + "\n" + common, None)] + EDGES
    for batch_lines in (1000, 12, 2):
        got = lines.dedup_lines(docs(spark, rows), batch_lines=batch_lines).collect()
        assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got], key=str) == brute_lines(rows)
    assert got[0].key == "y" and lines.dedup_lines(docs(spark, [])).collect() == []


def test_clashing_names_stay(spark):
    schema = "doc_id long, text string, n_lines int, __n int, __doc int, __gone string, n string, h1 int, at int"
    rows = [(i, "a line that is in more documents than four of them\nown", 77, 88, 99, "gone", "n", 5, 6) for i in range(6)]
    got = lines.dedup_lines(spark.createDataFrame(rows, schema), counts=("l", "d")).collect()
    assert all((r.n_lines, r["__n"], r["__doc"], r["__gone"], r.n, r.h1, r["at"], r.l) == (77, 88, 99, "gone", "n", 5, 6, 2) for r in got)
    assert sorted(r.d for r in got) == [0, 1, 1, 1, 1, 1]


def test_batches_are_anti_joined_with_runs(spark, monkeypatch):
    schema = "h1 long, h2 long, n long, top long"
    runs = lines.LineRuns(lines.Tables(spark), fanin=2)
    for batch in ([(1, 1, 1, 1), (2, 2, 1, 1)], [(2, 2, 1, 2), (3, 3, 1, 2)], [(4, 4, 2, 3), (2, 2, 1, 9)]):
        runs.add(spark.createDataFrame(batch, schema))
    assert [len(r) for r in runs.levels] == [1, 1] and len(runs.updates) == 2  # three batches: two merged, one on its own
    assert [r.h1 for r in runs.new_lines(spark.createDataFrame([(3, 3, 1, 9), (5, 5, 1, 9)], schema)).collect()] == [5]
    assert {r.h1: (r.n, r.top) for r in runs.common(1).collect()} == {1: (1, 1), 2: (3, 9), 3: (1, 2), 4: (2, 3)}
    assert {r.h1 for r in runs.common(2).collect()} == {2, 4}


def test_runs_share_buckets(spark):
    """The anti-join of a batch with runs shuffles nothing, nor does their merge."""
    tables = lines.Tables(spark)
    made = [tables.stored(spark.range(9000).select(F.xxhash64("id", F.lit(b)).alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n"), F.col("id").alias("top")).repartition(4, "h1", "h2")) for b in range(2)]
    runs = lines.LineRuns(tables)
    runs.levels[0].append(made[0])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in runs.new_lines(made[1])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in runs.new_lines(made[1]).unionByName(made[0]).groupBy("h1", "h2").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_levels_are_reached(spark, monkeypatch):
    seen = []
    known = lines.LineRuns.common
    monkeypatch.setattr(lines.LineRuns, "common", lambda self, least: seen.append(len(self.levels)) or known(self, least))
    lines.dedup_lines(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), batch_lines=100).count()
    assert seen == [3]


# ------------------------------------------------------------ URLs


def brute_url(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, a) for a, r in urls.LISTED if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in (host + path).lower()).split()
    bad = any(tuple(words[i : i + len(w)]) == w for w in urls.UNWANTED for i in range(len(words)))
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    given = [None, "", "nothing", "http://", "http://org", "http://org/", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/1x", "http://example.org/ES/", "http://example.org:80/es/", "x://notexample.org/es/", "http://a.com/de", "http://a.com/de/", "http://b.com/fr/cheap-pills", "http://cheap-pills.net/", "http://cheapxpills.net/", "http://a.net/casino?x", "http://a.net?casino", "a://b://c.org/", "http://x.net/CASINO", "http://casino.net/\nx", "http://org#x", "http://a.net/poker.html"] * 2
    rows = [(i if i else None, u, "y") for i, u in enumerate(given)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in got) and len(got) == len(rows)
    want = Counter((i, *brute_url(u)) for i, u, _ in rows)
    assert Counter(tuple(r) for r in got) == want
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_rules_without_tokens_run_on_every_url(spark):
    rules = (*urls.RULES, urls.Rule("block", None, r"\d{9}", ()))
    got = urls.judge(spark.createDataFrame([(1, "http://a.net/x123456789y"), (2, "http://a.net/")], "page_id long, url string"), rules)
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "allow"}


def test_many_rules_from_a_table(spark, tmp_path, monkeypatch):
    """50,000 rules read from storage; a URL runs only those filed under one of its tokens. Broadcast and shuffled alike."""
    rules = tuple(urls.Rule.listed("block" if i % 2 else "allow", f"site{i}.net/" if i % 5 else f"site{i}.net/a{i}/") for i in range(50_000))
    urls.rule_frame(spark, rules).write.parquet(f"{tmp_path}/rules")
    given = [(i, f"https://www.site{i * 7}.net/a{i * 7}/x") for i in range(3000)] + [(-1, "https://other.net/"), (None, None)] + [(9000 + i, "https://site1.net/") for i in range(1500)]
    pages = spark.createDataFrame(given, "page_id long, url string").repartition(3)
    want = Counter({(-1, None, "allow"): 1, (None, None, "allow"): 1})
    for i in range(3000):
        want[i, f"site{i * 7}.net/" if i * 7 % 5 else f"site{i * 7}.net/a{i * 7}/", "block" if i * 7 % 2 else "allow"] += 1
    want.update((9000 + i, "site1.net/", "block") for i in range(1500))
    for small in (urls.SMALL, 0):
        monkeypatch.setattr(urls, "SMALL", small)
        got = urls.judge(pages, spark.read.parquet(f"{tmp_path}/rules")).collect()
        assert Counter((r.page_id, r.rule, r.verdict) for r in got) == want


@pytest.mark.parametrize("name", ["pages", "documents"])
def test_oracles(spark, sf, name):
    run, sql = {"pages": (urls.op7_rare_token, urls.ORACLE), "documents": (lines.op6_line_runs, lines.ORACLE)}[name]
    db = duckdb.connect()
    db.sql(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    want = db.sql(sql)
    got = run(spark, sf).select(*want.columns).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())


# ------------------------------------------------------------ grades


def test_grades_hold_out(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").orderBy("doc_id").collect()
    grade = np.asarray([0 if r.toxic else 1 if not r.quality else 2 for r in labels])
    x = [quality.features(text[r.doc_id]) for r in labels]
    held = np.arange(len(x)) % 4 == 0
    model = quality.Ordinal.fit([a for a, h in zip(x, held, strict=True) if not h], grade[~held])
    assert (np.diff(model.thresholds) > 0).all()
    keep = model.tails(np.asarray([model.weights[a].sum() for a, h in zip(x, held, strict=True) if h]))[:, -1] >= quality.KEEP
    assert keep[grade[held] == 2].mean() > 0.95 and keep[grade[held] < 2].mean() < 0.3


def test_grade_edges(spark):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    train = [(i, "fine words in a row " * 5 if i % 2 else "BAD!! WORDS!! HERE!! " * 5, "s") for i in range(40)]
    got = quality.graded(docs(spark, train + [(None, None, "s"), (77, "", "s"), (3, train[3][1], "s")]), labels).collect()
    assert len(got) == 43 and all(0 <= r.p_keep <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert all((r.p_keep >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    none = quality.graded(docs(spark, EDGES), labels.limit(0))
    assert {r.p_keep for r in none.collect()} == {None} and quality.graded(docs(spark, []), labels).collect() == []


def test_ordinal_equals_a_dense_fit(spark):
    """The sparse fit against the likelihood of cumulative links written out over a dense matrix: no step lowers its loss much."""
    rng = np.random.default_rng(6)
    names = [quality.bucket(f"w word{i}") for i in range(12)]
    grade = rng.integers(0, 3, 900)
    rows = [np.asarray(sorted({names[j] for j in range(12) if rng.random() < (0.1 + 0.25 * (2 - g) if j < 6 else 0.3)}), np.int32) for g in grade]
    model = quality.Ordinal.fit(rows, grade)
    used = np.flatnonzero(model.weights)
    x = np.asarray([[b in set(r.tolist()) for b in used] for r in rows], float)

    def loss(w, t):
        cuts = np.concatenate([[-np.inf], t, [np.inf]])
        score = x @ w
        p = 1 / (1 + np.exp(-(cuts[grade + 1] - score))) - 1 / (1 + np.exp(-(cuts[grade] - score)))
        return -np.log(np.maximum(p, 1e-12)).mean() + 1e-3 * (w @ w) / 2  # the fit's decay

    w, t = np.zeros(len(used)), np.asarray([-1.0, 1.0])
    with np.errstate(over="ignore"):
        for _ in range(800):  # plain descent on numeric slopes
            g = np.asarray([(loss(w + h, t) - loss(w - h, t)) / 2e-4 for h in np.eye(len(w)) * 1e-4])
            k = np.asarray([(loss(w, t + h) - loss(w, t - h)) / 2e-4 for h in np.eye(2) * 1e-4])
            w, t = np.minimum(w - 1.0 * g, 0), t - 1.0 * k
        own, best = loss(model.weights[used], model.thresholds), loss(w, t)
    assert set(used) <= set(names[:6]) and len(used) == 6
    assert own <= best + 0.01
    tails = model.tails(np.asarray([0.0]))[0]
    assert np.allclose(tails, 1 / (1 + np.exp(model.thresholds))) and tails[0] > tails[1]


def test_grades_leave_clashing_names(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, "BAD!! " * 9 if i % 2 else "fine words", 7, "grade", 5.0) for i in range(40)]
    got = quality.graded(spark.createDataFrame(rows, "doc_id long, text string, __grade int, grade string, p_keep double"), labels)
    assert got.columns == ["doc_id", "text", "__grade", "grade", "expected_grade", "p_keep"]
    assert all(r["__grade"] == 7 and r.grade == "grade" and r.p_keep != 5.0 for r in got.collect())


# ------------------------------------------------------------ mixes


def brute_targets(sizes):
    """Shares by weight, what is above three times a source's size reshared until none is."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
    return target


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = EDGES + [(100 + i, "w " * int(rng.integers(0, 60)), ["a", "b", "c", "é", None, "zz"][int(rng.choice(6, p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02]))]) for i in range(3000)]
    frame = docs(spark, rows)
    got = mixing.mixed(frame).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, len((t or "").split()), s) for d, t, s in rows)
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in mixing.mixed(frame.repartition(7)).collect())
    mix = [(r.doc_id, r.text, r.source, r["size"], r.key, r.rule) for r in mixing.repeated(frame).collect()]
    assert Counter(mix) == Counter((r.doc_id, r.text, r.source, r["size"], r.key, r.rule) for r in mixing.repeated(frame.repartition(5)).collect())
    assert {m[3:] for m in mix} == {("x", "y", "z")}
    given, kept = Counter((d, t, s) for d, t, s in rows), Counter(m[:3] for m in mix)
    assert all(n <= 3 * given[k] for k, n in kept.items())
    for s in sizes:
        assert abs(sum(len((m[1] or "").split()) for m in mix if m[2] == s) - want[s]) <= largest[s]


def small(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def fits_filter(line, place):
    """Whether a filter line fits a place, by trying every start, character by character."""
    line, place = small(line.removeprefix("@@")), small(place)
    host = len(place.partition("/")[0])
    if line.startswith("||"):
        line, starts = line[2:], [0] + [i + 1 for i in range(host) if place[i] == "."]
    elif line.startswith("|"):
        line, starts = line[1:], [0]
    else:
        starts = range(len(place) + 1)
    anchored = line.endswith("|")
    line = line[:-1] if anchored else line
    reached = set(starts)
    for c in line:
        if c == "*":
            reached = set(range(min(reached), len(place) + 1)) if reached else set()
        elif c == "^":
            # The end is a separator that takes nothing.
            reached = {i + 1 for i in reached if i < len(place) and not (place[i].isascii() and (place[i].isalnum() or place[i] in "_.%-"))} | ({len(place)} & reached)
        else:
            reached = {i + 1 for i in reached if i < len(place) and place[i] == c}
    return len(place) in reached if anchored else bool(reached)


def test_filter_lists(spark):
    """Ten thousand filter lines with wildcards and anchors, against trying each on each URL."""
    draw = random.Random(11)
    names = ["ads", "track", "banner", "pix", "shop", "news", "cdn", "a1", "x", "promo9", "é", "\u212a"]

    def text(parts):
        return "".join(draw.choice(names) + draw.choice(parts) for _ in range(draw.randint(1, 3)))

    lines_of_filters = [draw.choice(["", "", "@@"]) + draw.choice(["", "|", "||"]) + draw.choice(["", "", f"site{i}"]) + text([".", "/", "*", "^", "-", "", "?"]) + draw.choice(["", "|", "^", "*", str(i)]) for i in range(10_000)]
    places = [text([".", "-", ""]) + draw.choice([".net", ".ORG", f".site{draw.randrange(10_000)}"]) + "/" + text(["/", "-", "_", ".", "K", "%"]) for _ in range(150)]
    bare = [draw.choice(["", "@@"]) + a + b for a in "qjzx-._" for b in "abcdefghijklmnopqrstuvwxyz0123456789|^"]  # without literals: more than a block
    pages = spark.createDataFrame([(i, "http://" + p) for i, p in enumerate(places)], "page_id long, url string")
    for own in (lines_of_filters, lines_of_filters[5::50], bare):
        rules = tuple(map(urls.Rule.filtered, own))
        assert (own is bare and sum(not r.tokens for r in rules) > urls.BLOCK) or all(r.tokens for r, line in zip(rules, own, strict=True) if re.search("[a-z0-9]{3}", line))
        listed = tuple(urls.Rule(r.action, line, r.pattern, r.tokens) for r, line in zip(rules, own, strict=True))
        want = {}
        for place in (small(p.partition("/")[0]) + "/" + p.partition("/")[2] for p in places):
            fits = [(len(line), -i) for i, line in enumerate(own) if fits_filter(line, place)]
            want[place] = own[-max(fits)[1]] if fits else None
        got = {(r.host + r.path): (r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
        assert got == {place: (line, "allow" if line is None or line.startswith("@@") else "block") for place, line in want.items()}
        assert len({*got.values()}) > 10


def test_mix_is_unbiased(spark):
    rows = [(i, "w " * (1 + i % 5), "a" if i < 150 else "b") for i in range(300)]
    total = Counter()
    for seed in range(12):
        mixing_rows = [(d + 1000 * seed, t, s) for d, t, s in rows]
        for r in mixing.mixed(docs(spark, mixing_rows)).collect():
            total[r.source, r.size] += r.copies
    got = mixing.mixed(docs(spark, rows)).first()
    assert got is not None
    for source in "ab":
        rate = [total[source, n] / (12 * 30) for n in range(1, 6)]
        assert max(rate) - min(rate) < 0.25


def test_mix_edges(spark):
    assert mixing.mixed(docs(spark, [])).collect() == []
    only = mixing.mixed(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in only} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    digest = hashlib.sha256(str(sorted(map(tuple, mixing.mixed(docs(spark, EDGES)).collect()), key=str)).encode()).hexdigest()
    assert digest == hashlib.sha256(str(sorted(map(tuple, mixing.mixed(docs(spark, EDGES[::-1])).collect()), key=str)).encode()).hexdigest()


def test_many_repeated_lines_take_time_in_proportion(spark):
    import time

    def took(lines_each):
        text = "\n".join(f"a line of forty characters and more, number {i}" for i in range(lines_each))
        rows = spark.createDataFrame([(d, text) for d in range(5)], "doc_id long, text string")
        start = time.time()
        got = lines.dedup_lines(rows).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("left")).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.left) for r in got) == [(d, lines_each, lines_each, 0) for d in range(4)] + [(4, lines_each, 0, len(text))]
        return time.time() - start

    took(1000)
    assert took(80_000) < 20 + 4 * took(20_000)
