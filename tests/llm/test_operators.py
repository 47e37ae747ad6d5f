import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, edits, exact, graph, lines, mixing, neardup, pii, quality, sharding, tokens, urls
from tessera.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, source string"
#: Names that operators use for their results, besides plain extras.
CLASH = ["size", "shard", "slot", "n_words", "items", "target", "copies", "kept", "keep_id", "host", "path", "rule", "verdict", "base", "added", "score", "predicted", "node", "h", "content", "_row", "_id", "_text"]


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi".split()) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal texts with other ids."""
    rng = random.Random(3)
    long = words(rng, 60_000)
    rows = [(1, "one line here\nthe other line", "a"), (2, None, "a"), (3, "", "b"), (None, "no id at all", "b"), (None, None, None), (4, long, None), (5, long, "a"), (6, "  spaced \t text ", "a"), (7, " spaced text ", "a"), (7, " spaced text ", "a"), (8, "x", "c"), (9, "x", "c"), (10, "...", "c"), (11, "ünï çødé 12 " * 9, "d")]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASH:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def test_sharding(spark, odd, none):
    df = spark.range(0, 5003, 1, 7).toDF("doc_id")
    out = sharding.shuffle_to_shards(df, 9, seed=5, cell_rows=100).collect()
    sizes = Counter(r["shard"] for r in out)
    assert sorted(r["doc_id"] for r in out) == list(range(5003)) and set(sizes.values()) == {555, 556}
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    again = sharding.shuffle_to_shards(df, 9, seed=5, cell_rows=100).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    # Neighbours part, and every source partition reaches every shard about evenly.
    first = Counter(r["shard"] for r in out if r["doc_id"] < 715)
    assert len(first) == 9 and max(first.values()) < 2 * 715 / 9
    assert sharding.shuffle_to_shards(odd, 4).count() == 14 and set(sharding.shuffle_to_shards(odd, 4).columns) >= {"text", "size", "shard"}
    assert sharding.shuffle_to_shards(none, 4).count() == 0


def test_sharding_after_a_shuffle(spark, tmp_path):
    """Adaptive execution may cut the partitions of a narrow and of a wide reading of one plan unlike each other."""
    spark.range(0, 9000, 1, 3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 50).alias("text")).write.parquet(str(tmp_path / "t"))
    files = spark.read.parquet(str(tmp_path / "t"))
    assert sharding._plain_read(files.select("doc_id").where("doc_id > 5")) and not sharding._plain_read(files.repartition(5))
    out = sharding.shuffle_to_shards(files.groupBy("doc_id").agg(F.first("text").alias("text")), 40).collect()
    sizes = Counter(r["shard"] for r in out)
    assert sorted(r["doc_id"] for r in out) == list(range(9000)) and set(sizes.values()) == {225}
    assert {(r["shard"], r["slot"]) for r in out} == {(s, i) for s in range(40) for i in range(225)}


def test_communication_matrix():
    prefix, cells = np.array([0, 100, 100, 250, 400]), np.array([150, 100, 150])
    rows = [sharding.partition_row(prefix, cells, p, 1) for p in range(4)]
    assert [r.sum() for r in rows] == [100, 0, 150, 150] and (sum(rows) == cells).all()
    rng = np.random.default_rng(0)
    large = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(50)]
    assert abs(np.mean(large) - 750_000) < 400 and np.std(large) < 1500


# 2


def test_tokens(spark, odd, none, tmp_path):
    out = tokens.write_training_order(odd, str(tmp_path / "a"), length=64, stride=100).orderBy("slot").collect()
    assert [r["slot"] for r in out] == list(range(len(out))) and all(r["shard"] == r["slot"] // 100 and len(r["ids"]) == 128 for r in out)
    t = tokens.Tokenizer()
    texts = {}
    for r in sorted(out, key=lambda r: (r["doc_id"] or 0, r["seq_no"])):
        texts.setdefault(r["doc_id"], []).append(bytes(r["ids"])[: 2 * r["n_tokens"]])
    want = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] not in (None, 7)}
    assert {k: t.decode(b"".join(texts[k])) for k in want} == want
    part = tokens.read_slots(spark, str(tmp_path / "a"), 150, 260, stride=100).collect()
    assert sorted(r["slot"] for r in part) == list(range(150, 260))
    assert tokens.write_training_order(none, str(tmp_path / "b")).count() == 0


def test_tokenizer_is_that_of_the_vocabulary():
    t = tokens.Tokenizer()
    for text in ["a \nb", "a\n b", "a  b   c", "it's  fine\n\n", "", "x²y ½ Ⅷ", "don't 's", "\x1c a", "\n", "\nA b", " lead", "tail ", "a\tb c_d __ e", "\ue000 x", "ж 漢字 ١٢"]:
        assert np.frombuffer(t.encode(text), "<u2").tolist() == t._whole.encode_ordinary(text), text


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_feistel_permutes(n):
    assert sorted(tokens.feistel(np.arange(n), n, 7)) == list(range(n))


# 3


def brute_leaks(text, items, span=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, which = find(text), set(), set()
    for name, item in items:
        w = find(item)
        n = min(span, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1 if n else 0):
            if tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                which.add(str(name))
    return len(own), len(hit), sorted(which)


def test_decontamination(spark, odd, none):
    rng = random.Random(4)
    items = [(i, words(rng, n)) for i, n in enumerate([40, 13, 12, 3, 1, 25])] + [(6, "same same " * 20), (7, None), (8, "..."), (9, ""), (None, words(rng, 20))]
    items += [(10, items[0][1].upper())]
    docs = []
    for i in range(60):
        parts = [words(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(item) + 1)
            parts += [" ".join(item[a : a + rng.randrange(8, 30)]), words(rng, rng.randrange(0, 5))]
        docs.append((i, ", ".join(parts), None))
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_leaks(t, [("" if n is None else n, x) for n, x in items]) for i, t, _ in docs}
    for size in (1 << 20, 200):  # one block; many
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.find_leaks(df, bench, block_bytes=size).collect()}
        assert got == want
    assert any(n for _, n, _ in want.values())
    assert decontam.find_leaks(odd, bench).count() == 14 and decontam.find_leaks(none, bench).count() == 0
    empty = decontam.find_leaks(odd, bench.limit(0)).collect()
    assert all(r["n_hit"] == 0 and r["items"] == [] for r in empty)


# 4


def test_mixing(spark, odd, none):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.choice([1, 5, 30, 200, 200, 2000])), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_sources(df, walk_rows=20).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(x for x in sizes if x) + [None]
    weight, target, rest = dict(zip(names, [5, 2, 1, 5, 2])), {}, 1.5 * sum(sizes.values())
    left = set(names)
    while True:  # the rule as it is told
        level = rest / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s], rest = 2 * sizes[s], rest - 2 * sizes[s]
            left.remove(s)
    target |= {s: weight[s] * level for s in left}
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    assert len(out) == 600 and all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in names)
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(mixing.mix_sources(df.repartition(3), walk_rows=20).collect()) == key(out)
    strange = mixing.mix_sources(odd).collect()
    assert len(strange) == 14 and all(r["taken"] == 0 for r in strange if not (r["text"] or "").strip())
    assert mixing.mix_sources(none).count() == 0


def test_rates_solve_the_dual(spark):
    """Against Newton steps on the whole system at once."""
    rng = random.Random(51)
    spread = {"a": [3, 40, 100, 150], "b": [9, 45, 100, 900, 1000], "c": [2, 2000], None: [5, 12, 50, 70, 110, 990]}
    stats = [(s, size, rng.randrange(1, 40)) for s, sizes in spread.items() for size in sizes]
    total = {s: sum(size * n for q, size, n in stats if q == s) for s in spread}
    target = {"a": 1.7 * total["a"], "b": 0.6 * total["b"], "c": 2.0 * total["c"], None: 1.1 * total[None]}
    rates, tilt = mixing.solve_rates(spark.createDataFrame(stats, "source string, size long, n long"), spark.createDataFrame([(s, total[s], target[s]) for s in spread], "source string, source_size long, target double"), Scratch(spark, "test"))
    got = {(r["source"], r["class"]): r["rate"] for r in rates.collect()}
    words_of = Counter()
    for s, size, n in stats:
        words_of[s, size.bit_length() - 1] += size * n
    cells = [k for k in words_of if k[0] != "c"]
    names, classes = ["a", "b", None], sorted({c for _, c in cells})
    goal = np.array([sum(v for k, v in words_of.items() if k[1] == c) for c in classes], float)
    goal *= sum(target[s] for s in names) / goal.sum()
    x, w = np.zeros(len(names) + len(classes)), np.array([words_of[k] for k in cells], float)
    rows = np.zeros((len(cells), len(x)))
    for i, (s, c) in enumerate(cells):
        rows[i, names.index(s)] = rows[i, len(names) + classes.index(c)] = 1
    ridge = np.append(np.zeros(len(names)), mixing.RIDGE * goal)
    for _ in range(300):
        r = 2 / (1 + np.exp(-rows @ x))
        slope = rows.T @ (rows * (w * r * (1 - r / 2))[:, None]) + np.diag(ridge)
        step = np.linalg.solve(slope, np.append([target[s] for s in names], goal) - rows.T @ (w * r) - ridge * x)
        x += step * min(1, 1 / np.abs(step).max())
    assert np.abs(step).max() < 1e-9 and max(map(abs, tilt.values())) > 0.1
    assert set(got) == set(words_of) and all(abs(got[k] - v) < 1e-6 for k, v in zip(cells, 2 / (1 + np.exp(-rows @ x)))) and {got[k] for k in got if k[0] == "c"} == {2.0}
    for s in names:
        assert abs(sum(words_of[k] * got[k] for k in cells if k[0] == s) - target[s]) < 1e-6 * target[s]


# 5


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host), len(r.path), r.verdict), default=None)


def test_urls(spark, none):
    rules = [urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr", "allow"), urls.Rule("org", "/fr/x", "block"), urls.Rule("a.org", "", "block")]
    hosts = ["net", "x.net", "EXAMPLE.net", "a.example.net", "notexample.net", "example.com", "b.a.org", "org", ".net", "example.net.", "é.org"]
    paths = ["", "/", "/en", "/en/", "/en/1?q=/de/", "/de/#x", "/fr", "/french", "/fr/x/y", "/fr/xy?z", "/de//"]
    given = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/x", "a://", "x://y://z/en/", "http://net?/en/", "http://u@net:80/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given)], "page_id long, url string, host string")
    by_trie = urls.judge_urls(df, rules).collect()
    for r in by_trie:
        host, path = urls.parse(r["url"])
        best = brute_rule(host, path, rules)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best and best.host + best.path, best.verdict if best else "allow"), r
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert sorted(map(str, urls.judge_urls(df, table, trie_rules=2).select(*by_trie[0].__fields__).collect())) == sorted(map(str, by_trie))
    assert urls.judge_urls(none.withColumnRenamed("text", "url"), rules).count() == 0
    # Repeated rows, very long urls and nulls.
    long = "http://a.org/" + "/".join(["seg"] * 40_000)
    rows = spark.createDataFrame([(1, long), (1, long), (2, "http://" + "x." * 20_000 + "net/"), (None, None)], "page_id long, url string")
    got = sorted((r["rule"] or "", r["verdict"]) for r in urls.judge_urls(rows, rules).collect())
    assert got == [("", "allow"), ("a.org", "block"), ("a.org", "block"), ("net/", "block")]


# 6


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    bits = ["a", "@", ".", "b@c.d", "1", "23", "255", "256", "4539 1488-0343 6467", "+1 (555) 010-9999", " ", "-", "+", "\n", "é", "😀", "10.0.0.1", "0.0.0.", "%", "@@"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000) == []


def test_bootstrapping(spark, odd, none):
    rows = [(i, f"please call +1 (555) 010-{1000 + i} today, thanks", None) for i in range(12)]
    rows += [(100, "please call 555 0199 7777 today, or not", None), (101, "order 555 0199 8888 was sent", None), (102, "please call 1999 today", None)]
    out = {r["doc_id"]: r for r in pii.personal_data_digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[0]["n_phone"] == 1 and out[0]["n_added"] == 0 and out[0]["base_sha256"] == hashlib.sha256(out[0]["spans"].encode()).hexdigest()
    assert out[100]["spans"] == "phone:12:25" and out[100]["n_phone"] == 0 and out[101]["spans"] == "" and out[102]["spans"] == ""
    # More unseen identifiers than seeds, patterns of one side, and a pattern that only found identifiers induce; numbers elsewhere stay.
    rng = random.Random(61)
    number = lambda: f"{rng.randrange(200, 999)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)}"
    rows, planted = [], set()
    for i in range(12):
        rows.append((i, f"{words(rng, 5)} reach me at +1 (555) 010-{1000 + i} {words(rng, 5)}", None))
    twice = [number() for _ in range(4)]
    for i in range(100, 120):
        rows.append((i, f"{words(rng, 5)} reach me at {twice[i % 4] if i < 108 else number()} {words(rng, 5)}", None))
        planted.add(i)
    for i in range(200, 204):
        rows.append((i, f"{words(rng, 5)} mobile no: {twice[i % 4]} {words(rng, 5)}", None))
        planted.add(i)
    for i in range(204, 206):
        rows.append((i, f"{words(rng, 5)} mobile no: {number()} {words(rng, 5)}", None))
        planted.add(i)
    for i in range(300, 340):
        rows.append((i, f"{words(rng, 5)} order {number()} {words(rng, 5)}", None))
    # A context that seeds of several kinds and other numbers share says nothing.
    for i in range(400, 440):
        rows.append((i, f"{words(rng, 5)} of the {['+1 (555) 020-' + str(1000 + i), 'x' + str(i) + '@mail.example', '10.0.0.' + str(i % 250), number()][i % 4]} {words(rng, 5)}", None))
    got = {r["doc_id"] for r in pii.personal_data_digest(spark.createDataFrame(rows, SCHEMA)).collect() if r["n_added"]}
    assert got == planted
    assert pii.find_personal_data(odd).count() == 14 and pii.personal_data_digest(none).count() == 0


# 7


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def test_lines(spark, odd, none):
    rng = random.Random(7)
    base = [words(rng, 40) for _ in range(12)]
    docs = []
    for i in range(40):
        own = []
        for _ in range(4):
            line = rng.choice(base)
            if rng.random() < 0.5:
                line = line.replace("a", "A").replace(" ", "  ", 1) + "!"
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("qz") + line[at + 1 :]
            own.append(line)
        docs.append((i, "\n".join([*own, "short"]), None))
    df = spark.createDataFrame(docs, SCHEMA)
    got = lines.fuzzy_lines(df, least_chars=24).collect()
    assert len(got) == 160
    text = {bytes(r["node"]): r["norm"] for t in docs for r in [{"node": hashlib.md5(x).digest(), "norm": x.decode()} for x in lines.normalised_lines(t[1])]}
    by_spark = df.select(F.explode(F.split("text", "\n")).alias("line")).select(lines.normalised_line("line").alias("norm")).distinct().collect()
    assert {r["norm"] for r in by_spark} == set(text.values())
    nodes = [n for n in text if len(text[n]) >= 24]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if edit_similarity(text[a], text[b]) >= lines.SIMILARITY:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {bytes(r["node"]): bytes(r["class"]) for r in got} == {n: find(n) for n in nodes}
    kept = [(r["doc_id"], r["line_no"]) for r in got if r["kept"]]
    first = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["line_no"])):
        first.setdefault(bytes(r["class"]), (r["doc_id"], r["line_no"]))
    assert sorted(kept) == sorted(first.values())
    cut = {r["doc_id"]: r["text"] for r in lines.drop_fuzzy_lines(df, least_chars=24).collect()}
    assert sum(len(t.split("\n")) for t in cut.values()) == len(kept) + 40
    assert lines.line_digest(odd).count() == 14 and lines.drop_fuzzy_lines(odd).count() == 14 and lines.line_digest(none).count() == 0
    # Rows that are repeated with the same id are one document.
    twice = lines.drop_fuzzy_lines(odd.select("doc_id", "text")).where("doc_id = 7").collect()
    assert [r["text"] for r in twice] == ["", ""] or [r["text"] for r in twice] == [" spaced text "] * 2


def test_lines_by_edits_alone(spark):
    rng = random.Random(71)
    base = [words(rng, n) for n in (6, 10, 20, 30, 40, 60) * 3]
    docs = []
    for i in range(60):
        own = rng.choice(base).split()
        for _ in range(rng.randrange(1 + len(own) // 10)):
            own[rng.randrange(len(own))] = words(rng, 1)
        docs.append((i, " ".join(own), None))
    norm = dict(zip(range(60), (lines.normalised_lines(text)[0].decode() for _, text, _ in docs)))
    sig = lines.simhash([t.encode() for t in norm.values()]).tolist()
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for i in range(60):
        for j in range(i):
            if edit_similarity(norm[i], norm[j]) >= lines.SIMILARITY:
                far += bin(sig[i] ^ sig[j]).count("1") > 3
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    df = spark.createDataFrame(docs, SCHEMA)
    got = {r["doc_id"]: r["n_dropped"] for r in lines.line_digest(df).collect()}
    assert far > 30 and got == {i: int(find(i) != i) for i in range(60)}
    cut = lines.drop_fuzzy_lines(df).where("text != ''").collect()
    assert {r["doc_id"] for r in cut} == {i for i in range(60) if find(i) == i}


def test_short_lines(spark):
    docs = [(1, "Home\nEin Satz, der hier steht und lang genug ist.\n...\nHome", None), (2, "home!\nAll rights reserved\n", None), (3, "all rights  reserved.\nx", None), (4, "y\nHOME", None)]
    got = {r["doc_id"]: (r["n_judged"], r["dropped_lines"]) for r in lines.line_digest(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: (3, "3"), 2: (2, "0"), 3: (2, "0"), 4: (2, "1")}


def test_blocks_meet():
    """The shares of pairs with some words or characters replaced that have a block in common; of few words with one replaced or left out, all."""
    rng = random.Random(72)

    def shares(pairs):
        own, keys = lines.line_blocks(pairs)
        of = [set(keys[own == i].tolist()) for i in range(len(pairs))]
        return np.mean([bool(x & y) for x, y in zip(of[::2], of[1::2])])

    # With this seed 1.0 and 0.97 with one word in twenty and in ten replaced, 0.93 and 0.53 with edits in one of forty and of twenty characters.
    for changed, of, least in (("words", 20, 0.99), ("words", 10, 0.95), ("characters", 40, 0.9), ("characters", 20, 0.5)):
        pairs = []
        for _ in range(400):
            x = words(rng, 40)
            if changed == "words":
                own = x.split()
                for at in rng.sample(range(40), 40 // of):
                    own[at] = words(rng, 1)
                y = " ".join(own)
            else:
                own = list(x)
                for at in rng.sample(range(len(x)), len(x) // of):
                    own[at] = "#"
                y = "".join(own)
            pairs += [x.encode(), y.encode()]
        assert shares(pairs) >= least, changed
    few = []
    for n in range(2, lines.FEW_WORDS + 1):
        own = words(rng, n).split()
        at = rng.randrange(n)
        few += [" ".join(own).encode(), " ".join(own[:at] + ["other"] + own[at + 1 :]).encode(), " ".join(own).encode(), " ".join(own[:at] + own[at + 1 :]).encode()]
    assert shares(few) == 1 and len(lines.line_blocks([b"", b" "])[0]) == 0
    assert shares(["\u6f22\u5b57\u4eee\u540d\u6587\u7ae0".encode(), "\u6f22\u5b57\u4eee\u540d\u6587\u5b66".encode()]) == 1
    # A block is the SimHash of its words.
    x = lines.simhash([b"ab cd ef gh ij kl mn", b"mn ef gh ab cd ij kl", b"ab cd"])
    assert x[0] == x[1] != x[2] and lines.line_blocks([b"ab cd ef gh ij kl mn"], few=0)[1][0] == lines.mix(x[:1])[0]


def test_edit_distance():
    rng = random.Random(73)
    for _ in range(400):
        x, y = ("".join(rng.choice("ab\u00e9\u6f22 ") for _ in range(rng.randrange(90))) for _ in range(2))
        if rng.random() < 0.6:
            y = "".join(c for c in x if rng.random() < 0.9)
        want = round((1 - edit_similarity(x, y)) * max(len(x), len(y), 1))
        assert lines._distance(*sorted((x, y), key=len), 99) == want
        assert all(lines.within(x, y, most) == (want <= most) for most in range(0, 60, 7))
    texts = [words(rng, n) for n in rng.choices([1, 3, 8, 15, 30], k=40)]
    texts += ["".join(c for c in t if rng.random() < 0.85) + rng.choice(["", "q", "x yz"]) for t in texts for _ in range(2)]
    table = lines._Table([t.encode() for t in texts])
    rows, others = map(np.ravel, np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = table.alike(rows, others, 0.8)
    for x, y, like in zip(rows.tolist(), others.tolist(), got.tolist()):
        if rng.random() < 0.05 or like:
            assert like == (edit_similarity(texts[x], texts[y]) >= 0.8)
    assert 80 < got.sum() < 1000


def test_edit_distances_at_once():
    """Many pairs at once are those that are found one by one, with few and with many characters."""
    rng = random.Random(74)
    for letters, exact in (("ab ", True), ("".join(map(chr, range(0x4E00, 0x5000))), False)):
        texts = []
        for _ in range(40):
            own = "".join(rng.choices(letters, k=rng.randrange(1, 200)))
            texts += [own, "".join(c for c in own if rng.random() > 0.15), own[rng.randrange(9) :] + "a b"]
        codes = edits.Codes(texts)
        rows, others = map(np.ravel, np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        most = codes.lengths[rows] // 5
        some = np.abs(codes.lengths[rows] - codes.lengths[others]) <= most
        rows, others, most = rows[some], others[some], most[some]
        asked = []
        got = codes.within(rows, others, most, lambda x, y, m: asked.append(x) or lines.within(texts[x], texts[y], m))
        want = [lines.within(texts[x], texts[y], m) for x, y, m in zip(rows.tolist(), others.tolist(), most.tolist())]
        assert codes.exact == exact and got.tolist() == want and sum(want) > 150 and len(asked) < len(rows) // 2


def test_pairs_are_compared_once(monkeypatch):
    """Rows of one chunk of an earlier level are not compared again; the others are."""
    rng = random.Random(75)
    texts = [words(rng, 30).encode() for _ in range(12)]
    texts[7] = texts[1] + b" x"
    asked = []
    alike = lines._Table.alike
    monkeypatch.setattr(lines._Table, "alike", lambda self, x, y, s: asked.extend(zip(x.tolist(), y.tolist())) or alike(self, x, y, s))
    of = lines._classes(texts, np.array([0, 12]), [(np.zeros(12, int), np.arange(12) // 6)], similarity=0.8)
    pairs = {(min(p), max(p)) for p in asked}
    assert len(pairs) == len(asked) and all(x < 6 <= y for x, y in pairs)
    assert of[1] == of[7] and len(set(of.tolist())) == 11


def test_few_pairs_need_a_table_of_edits(monkeypatch):
    """Bounds and passages tell of most pairs, and of none wrongly; classes are those of all pairs, though what is left open is compared last."""
    rng = random.Random(76)
    for letters in ("ab", "abcdefgh \u00e9", "".join(map(chr, range(0x4E00, 0x5000)))):
        texts = []
        for _ in range(50):
            own = "".join(rng.choices(letters, k=rng.randrange(150)))
            texts += [own, "".join(c for c in own if rng.random() > 0.12), own[9:] + own[: rng.randrange(30)]]
        table = lines._Table([t.encode() for t in texts])
        rows, others = map(np.ravel, np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
        like, left = table.told(rows, others, 0.8)
        most = np.floor(0.2 * np.maximum(table.lengths[rows], table.lengths[others]) + 1e-9).astype(int).tolist()
        want = np.array([lines.within(texts[x], texts[y], m) for x, y, m in zip(rows.tolist(), others.tolist(), most)])
        settled = np.ones(len(rows), bool)
        settled[left] = False
        assert (like[settled] == want[settled]).all() and not like[left].any()
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n))
    common = own(12)
    texts = [f"{own(30)} {common} {own(30)}" for _ in range(40)] + ["the " * 90 + own(10), "of " * 120 + own(10)]
    texts += [" ".join(w if rng.random() < 0.85 else own(1) for w in t.split()) for t in texts[:20]]
    asked = []
    exactly = lines._Table.exactly
    monkeypatch.setattr(lines._Table, "exactly", lambda self, x, y, s: asked.extend(x.tolist()) or exactly(self, x, y, s))
    of = lines._classes([t.encode() for t in texts], np.array([0, len(texts)]), similarity=0.8)
    label = list(range(len(texts)))
    for x in range(len(texts)):
        for y in range(x):
            if lines.within(texts[x], texts[y], int(0.2 * max(len(texts[x]), len(texts[y])) + 1e-9)):
                label = [label[y] if z == label[x] else z for z in label]
    assert len(set(zip(of.tolist(), label))) == len(set(of.tolist())) == len(set(label)) < len(texts) - 10
    assert len(asked) < 200  # of 1891 pairs


def test_chunk_numbers():
    got = graph._chunk_numbers(np.array([5, 5, 5, 0, 0, 7]), np.array([1, 0, 1, -1, -1, 1])).tolist()
    assert got[0] == got[2] and len(set(got)) == 5


# 8


def test_near_duplicates(spark, odd, none):
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        own = words(rng, rng.choice([4, 30, 120, 300])).split()
        texts.append(" ".join(own))
        for _ in range(rng.randrange(6)):
            copy = list(own)
            for _ in range(rng.randrange(len(own) // 40 + 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    common = words(rng, 60)
    texts += [common + " " + words(rng, 60) for _ in range(10)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    n = len(texts)
    every = Counter(s for t in texts for s in set(neardup.distinct_shingles([t.encode()])[1].tolist()))
    for floor in (neardup.FLOOR, 0.0005):
        found, counts, n_docs, least = neardup.frequent_shingles(df, "text", Scratch(spark, "test"), floor)
        assert least == floor * every.total() and n_docs == n and dict(zip(found.tolist(), counts.tolist())) == {s: c for s, c in every.items() if c > least}
    weights = neardup.Weights(*neardup.frequent_shingles(df, "text", Scratch(spark, "test")))
    assert 1 < least < 5 and weights(np.array([0], np.uint64), np.array([1]))[0] == np.float32(np.log1p(n))
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if texts[i] == texts[j] or neardup.weighted_jaccard(weights, texts[i].encode(), texts[j].encode()) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = neardup.near_groups(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: find(i) for i in range(n)}
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    strange = neardup.near_groups(odd).collect()
    assert len(strange) == 14 and sum(r["kept"] for r in strange) == len({bytes(r["node"]) for r in strange}) - 1  # two spacings of one text
    assert neardup.drop_near_duplicates(odd).count() == sum(r["kept"] for r in strange) and neardup.drop_near_duplicates(odd).columns == odd.columns
    assert neardup.near_groups(none).count() == 0


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 2**63, 400).astype(np.uint64)
    w = rng.gamma(2, 1, 400).astype(np.float32)
    a, b = slice(0, 300), slice(60, 360)
    v = w.copy()
    v[100:200] *= 1.5
    both = [neardup.samples(np.zeros(300, int), names[x], y[x], 1, 2000)[0] for x, y in ((a, w), (b, v))]
    x, y = np.zeros(400), np.zeros(400)
    x[a], y[b] = w[a], v[b]
    assert abs((both[0] == both[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in {x for e in edges if e[0] != e[1] for x in e}}


# 9


@pytest.mark.parametrize("budget", [200, 64 << 20])
def test_exact(spark, odd, none, budget):
    rng = random.Random(10)
    rows = [(rng.randrange(10**6), rng.choice(["a  b", "a b", "a\tb", "", None, " ", "c", words(rng, 3)]), None) for _ in range(300)]
    out = exact.exact_groups(spark.createDataFrame(rows, SCHEMA), table_bytes=budget).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    assert len(out) == 300
    for r in out:
        own = groups[norm(r["text"])]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(own), len(own), r["doc_id"] == min(own), hashlib.sha256(norm(r["text"]).encode()).hexdigest())
    assert exact.exact_groups(odd, table_bytes=budget).count() == 14 and exact.exact_groups(none).count() == 0


def test_equal_hashes_are_told_apart():
    records = [(7, b"a", 1, 1), (7, b"b", 2, 1), (7, b"a", 0, 1), (7, b"c" * 500, 3, 2)]
    assert sorted((c, i, n) for _, c, i, n in exact.grace(iter(records), 10)) == [(b"a", 0, 2), (b"b", 2, 1), (b"c" * 500, 3, 2)]


# 10


def test_quality(spark, odd, none):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.3
        text = words(rng, rng.randrange(5, 60))
        rows.append((i, text.upper().replace(" ", "!! ") if bad else text, None))
        labels.append((i, int(not bad)))
    df, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(df, marks.where(~quality.held_out()))
    assert len(model.y) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400))
    got = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    apart = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == labels[i][1] for i in apart) >= 0.97 * len(apart)
    strange = quality.score_quality(odd, model).collect()
    assert len(strange) == 14 and all(0 <= r["score"] <= 1 for r in strange) and quality.score_quality(none, model).count() == 0
    blank = quality.train(none, marks.limit(0))
    assert {r["score"] for r in quality.score_quality(odd, blank).collect()} == {0.5}
    # A neighbour of the same text decides.
    exact_model = quality.Model(quality.pair_counts([b"good good", b"BAD!! BAD!!"]), np.array([1.0, 0.0], np.float32), np.zeros(quality.FEATURES), 2)
    assert exact_model.score([b"good good", b"BAD!! BAD!!"], neighbours=1).tolist() == [1.0, 0.0]
