"""SimHash, line quality and decontamination against brute force."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, line_quality, simhash
from corpusmill.llm.common import connected_components, stage
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=3):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(values, 2):
        if bin(a ^ b).count("1") <= radius:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(3)
    vectors = [1 + i % 15 for i in range(64)]
    assert len(masks) == 15
    for bits in itertools.combinations(sorted(set(range(15))), 3):  # the masks depend on the vectors only
        assert any(all(not m >> b & 1 for b in bits) for m in masks)
    assert all(vectors[b] == vectors[b + 15] for b in range(49))


@pytest.mark.parametrize("full_bucket", [256, 2])
def test_links_equal_brute_force(spark, full_bucket):
    rng = random.Random(3)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(25)}
    values |= {rng.getrandbits(64) for _ in range(200)}
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in values], "fingerprint long")
    links = connected_components(simhash.fingerprint_links(nodes, 3, full_bucket)).collect()
    found = collections.defaultdict(set)
    for r in links:
        found[r["label"]].add(r["node"] & (2**64 - 1))
    groups = collections.defaultdict(set)
    for v, root in slow_components(values).items():
        groups[root].add(v)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (900, 901)], "a long, b long")
    found = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(301)} | {900: 900, 901: 900}


def test_near_duplicates_equal_brute_force(sample):
    rows = sample.collect()
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows}
    root = slow_components(set(prints.values()))
    first = {}
    for i in sorted(prints):
        first.setdefault(root[prints[i]], i)
    for r in simhash.near_duplicates(sample).collect():
        assert r["fingerprint"] & (2**64 - 1) == prints[r["id"]]
        assert r["component_id"] == first[root[prints[r["id"]]]]


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    found = simhash.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    by_id = collections.defaultdict(set)
    for r in found:
        by_id[r["id"]].add((r["fingerprint"], r["component_id"]))
    assert by_id[1] == by_id[2] and {c for _, c in by_id[1]} == {1}
    assert by_id[3] == by_id[4] == by_id[5] == {(0, 3)}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 6, 7, 7, 8, 9]
    assert kept.where("doc_id is null").count() == 1  # the null row with text; the one without joins the empty texts
    assert simhash.drop_near_duplicates(nothing).count() == 0


def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_rules_equal_brute_force(spark, sample, awkward):
    texts = ["a b c d e f a b c d e f a b c d e", "a a a a a a a a a a a a", "one\ntwo\none\n\n\n two\n", "x " * 4000, "p q r s t u p q r s t"]
    extra = spark.createDataFrame([(1000 + i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for docs in (sample, extra, awkward.where("doc_id <> 7 and doc_id <> 1")):
        expected = {r["doc_id"]: slow_base(r["text"]) for r in docs.collect()}
        for r in line_quality.line_verdicts(docs).collect():
            assert tuple(r[c] for c in BASE) == expected[r["id"]], r["id"]


def slow_key(line):
    return re.sub(r"[\W_]+", " ", re.sub(r"\d", "0", line.lower())).strip()


def boilerplate_docs():
    line, own = "All rights are reserved by the 2024 publisher.", "Read 3 more stories on our front page now."
    docs = [(i, f"{line}\n{prose(100 + i, 60)}\n{own.replace('3', str(i % 10))}", "a") for i in range(30)]  # kept without those lines
    docs += [(100 + i, f"{line}\n{prose(300 + i, 4)}\n{own}", "a") for i in range(5)]  # depleted
    docs += [(200 + i, f"{line}\n{prose(400 + i, 60)}", "b") for i in range(5)]  # another host, below its limit
    whole = [prose(500 + k, 40) for k in range(5)]
    docs += [(300 + i, "\n".join(whole), "c") for i in range(40)]  # exact copies are one document
    for i in range(40):  # near copies are repeated content, not boilerplate
        words = "\n".join(prose(600 + k, 40) for k in range(5)).split(" ")
        words[i * 4 + 3] = f"changed{i}"
        docs.append((400 + i, " ".join(words), "d"))
    return docs


def test_common_lines_and_depletion(spark):
    docs = spark.createDataFrame(boilerplate_docs(), "doc_id long, text string, source string")
    found = {r["id"]: r for r in line_quality.line_verdicts(docs).collect()}
    assert all(found[i]["kept"] and found[i]["removed_words"] == 17 for i in range(30))
    assert not any(found[100 + i]["kept"] for i in range(5)) and not found[100]["base_failed"]
    assert all(found[i]["kept"] and found[i]["removed_words"] == 0 for i in [*range(200, 205), *range(300, 340), *range(400, 440)])
    kept = {r["doc_id"]: r for r in line_quality.apply_line_rules(docs.withColumn("n_chars", F.length("text"))).collect()}
    assert 100 not in kept and kept[3]["text"] == prose(103, 60) and kept[3]["n_chars"] == len(kept[3]["text"])
    assert kept[200]["text"] == boilerplate_docs()[35][1]


def test_native_fingerprint_is_the_fingerprint(spark, sample, awkward):
    docs = sample.select("doc_id", "text").limit(100).union(awkward.select("doc_id", "text"))
    for r in docs.select("text", simhash.native_fingerprint(F.col("text")).alias("f")).collect():
        assert r["f"] & (2**64 - 1) == slow_fingerprint(r["text"])


def test_near_copies_and_templates_do_not_exempt_a_line(spark):
    shell = [prose(700 + k, 60) for k in range(5)]
    docs = [(i, "\n".join([*shell, prose(800 + i, 54)]), "template") for i in range(40)]  # 300 shared words, 54 own
    line = "One line that all of this host's documents hold."
    base = prose(900, 600).split(" ")
    for i in range(60):  # one group of near copies beside 20 documents with the same line
        words = list(base)
        words[9 * i] = f"changed{i}"
        docs.append((100 + i, f"{' '.join(words)}\n{line}", "copies"))
    docs += [(200 + i, f"{prose(1000 + i, 60)}\n{line}", "copies") for i in range(20)]
    docs += [(300 + i, docs[40 + i][1], "few") for i in range(60)] + [(400 + i, f"{prose(1100 + i, 60)}\n{line}", "few") for i in range(8)]
    found = {r["id"]: r for r in line_quality.line_verdicts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(not found[i]["kept"] and found[i]["removed_words"] == 300 for i in range(40))
    assert all(found[i]["kept"] and found[i]["removed_words"] == 9 for i in [*range(100, 160), *range(200, 220)])
    assert all(found[i]["kept"] and found[i]["removed_words"] == 0 for i in [*range(300, 360), *range(400, 408)])


def test_short_lines_and_the_limit_of_depletion(spark):
    menu = ["Home", "Log in", "Read more", "Contact", "About us", "Shop", "Help", "Search"]  # 11 words
    docs = [(i, "\n".join([*menu, prose(1200 + i, 30), "---"]), "menu") for i in range(20)]
    docs += [(100 + i, "\n".join([*menu, f"Visit{chr(97 + i)} page"]), "menu") for i in range(5)]  # a menu and nothing else
    shell = prose(1300, 60)
    docs += [(200 + i, f"{shell}\n{prose(1400 + i, 61)}", "half") for i in range(20)]  # loses just under a half
    docs += [(300 + i, f"{shell}\n{prose(1500 + i, 59)}", "half") for i in range(20)]  # and just over
    found = {r["id"]: r for r in line_quality.line_verdicts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(found[i]["kept"] and found[i]["removed_words"] == 11 for i in range(20))
    assert all(not found[i]["base_failed"] and not found[i]["kept"] for i in range(100, 105))
    assert all(found[i]["kept"] for i in range(200, 220)) and not any(found[i]["kept"] for i in range(300, 320))


def test_a_limit_is_a_share_of_the_host(spark):
    docs = [(i, f"{prose(3000 + i, 20)}\n" + ("References" if i < 11 else "Contents" if i < 60 else "Home"), "large") for i in range(2000)]
    docs += [(5000 + i, f"{prose(6000 + i, 20)}\nReferences", "small") for i in range(11)]
    found = {r["id"]: r["removed_words"] for r in line_quality.line_verdicts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert {found[i] for i in range(11)} == {0} and {found[i] for i in range(11, 60)} == {1} and {found[i] for i in range(60, 2000)} == {1}
    assert {found[5000 + i] for i in range(11)} == {1}


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [f"{prose(2000 + k, rng.randint(1, 6))}, {k} times!" for k in range(30)] + ["***", " "]
    docs = []
    for i in range(150):
        lines = [prose(2100 + 40 * i + k, rng.randint(4, 12)) for k in range(rng.randint(1, 4))] + [rng.choice(pool[: rng.choice([3, 32])]) for _ in range(rng.randint(0, 8))]
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), rng.choice("abc")))
    held = collections.defaultdict(set)
    for i, text, host in docs:
        for line in text.split("\n"):
            held[host, slow_key(line)].add(text)
    expected = {}
    for i, text, host in docs:
        count = lambda t: len(WORD.findall(t))
        lost = sum(count(x) for x in text.split("\n") if slow_key(x) and len(held[host, slow_key(x)]) > 10)
        words = WORD.findall(text)
        windows = collections.Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        expected[i] = (failed, not failed and not (lost > 0.5 * len(words) or len(words) - lost < 10), lost)
    found = line_quality.line_verdicts(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r["id"]: (r["base_failed"], r["kept"], r["removed_words"]) for r in found} == expected
    assert {v[1] for v in expected.values()} == {True, False} and any(v[2] for v in expected.values())


def test_line_rules_on_awkward_rows(awkward, nothing):
    assert line_quality.line_verdicts(awkward).count() == awkward.count()
    assert line_quality.line_verdicts(nothing).count() == 0
    kept = line_quality.apply_line_rules(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 1").count() == 2
    assert line_quality.apply_line_rules(nothing).count() == 0


def test_seeds_hit_every_window():
    for lost in itertools.combinations(range(13), 2):
        assert any(all(at + o not in lost for o in seed) for seed in decontamination.SEEDS for at in range(13 - seed[-1]))


def plain(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def slow_leaks(docs, items):
    found = set()
    for d, text in docs:
        words = plain(text)
        for i, item in items:
            other = plain(item)
            if len(other) < 13 or sum(w in set(words) for w in other) < 11:
                continue
            for shift in range(13 - len(other), len(words) - 12):
                first, end = max(0, -shift), min(len(other), len(words) - shift)
                same = [other[k] == words[k + shift] for k in range(first, end)]
                if any(sum(same[k : k + 13]) >= 11 for k in range(len(same) - 12)):
                    found.add((d, i))
    return found


def test_decontamination_equals_brute_force(spark, sample, bench_items):
    rng = random.Random(4)
    items = [(r["item_id"], r["text"]) for r in bench_items.collect()]
    planted = []
    for k, (i, text) in enumerate(items):
        words = text.split(" ")
        for at in range(6, len(words), 7):
            words[at] = "other"
        planted.append((10_000 + k, f"{prose(k, 30)} {' '.join(words)} {prose(k + 50, 30)}"))
        planted.append((20_000 + k, f"{prose(k, 30)} {' '.join(text.split(' ')[:13])} {prose(k + 50, 30)}"))
        planted.append((30_000 + k, " ".join(rng.sample(text.split(" "), len(words)))))
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()] + planted
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench_items)
    assert {(r["id"], r["item"]) for r in found.collect()} == slow_leaks(docs, items)


def test_decontamination_of_awkward_rows(spark, awkward, nothing, bench_items):
    base = prose(1, 60)
    items = spark.createDataFrame([(1, base), (1, base), (2, None), (3, ""), (4, "too short"), (None, prose(6, 40))], "item_id long, text string")
    found = {(r["id"], r["item"]): (r["start"], r["n_words"], r["n_matches"]) for r in decontamination.contaminated(awkward, items).collect()}
    assert found[1, 1] == found[2, 1] == (0, 60, 60) and found[7, None] == (0, 40, 40)
    kept = decontamination.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.where("doc_id in (1, 2)").count() == 0 and kept.where("doc_id = 7").count() == 1
    assert decontamination.contaminated(nothing, items).count() == 0 and decontamination.contaminated(awkward, items.where("false")).count() == 0
    assert decontamination.drop_contaminated(awkward, items.where("false")).count() == awkward.count()


def test_short_items_are_found_whole(spark):
    items = spark.createDataFrame([(1, "Which river, in 1849, flows through Ulm?"), (2, "Name one!"), (3, "common words"), (4, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    docs = [(i, f"{prose(i, 20)} common words {prose(i + 50, 20)}") for i in range(30)]
    docs += [(100, f"{prose(1, 9)} which river in 1849 flows through ulm {prose(2, 9)}"), (101, "which river in 1849 flows through"), (102, "x name one"), (103, "one two three four five six seven eight nine ten eleven twelve"), (104, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lambda **o: {(r["id"], r["item"], r["start"], r["n_words"], r["n_matches"]) for r in decontamination.contaminated(table, items, **o).collect()}
    rare = {(100, 1, 9, 7, 7), (102, 2, 1, 2, 2), (103, 4, 0, 12, 12)}
    assert rows() == rare | {(i, 3, 20, 2, 2) for i in range(30)}
    assert rows(generic_words=5) == rare
    assert {r["doc_id"] for r in decontamination.drop_contaminated(table, items, generic_words=5).collect()} == {*range(30), 101, 104}


def test_bit_majority_blocks():
    values = [random.Random(1).getrandbits(64) for _ in range(simhash.BLOCK + 5)]
    bits = np.array(values, "<u8")
    expected = sum(1 << b for b in range(64) if 2 * int(((bits >> np.uint64(b)) & np.uint64(1)).sum()) > len(values))
    assert simhash.bit_majority(iter(values)) & (2**64 - 1) == expected


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_repeated_for_salts_or_around_values_are_not_broadcast(spark, monkeypatch):
    lines = spark.range(60).selectExpr("id row", "concat('src', id % 3) host", "id % 5 h")
    common = stage(spark.range(4).selectExpr("concat('src', id % 2) host", "id % 3 h"), "common")
    rows = lambda df: sorted(tuple(r) for r in df.select("row", "host", "h").collect())
    plain = line_quality.with_common(lines, common, "row", 32)
    assert "explode" not in plan_of(plain)
    monkeypatch.setattr(line_quality, "PLAIN_LINES", 0, raising=False)
    salted = line_quality.with_common(lines, common, "row", 32)
    assert "BroadcastHashJoin" not in plan_of(salted)
    assert rows(salted) == rows(plain) == rows(lines.join(common, ["host", "h"])) != []
    nodes = spark.range(40).selectExpr("shiftleft(1L, cast(id as int)) fingerprint")
    monkeypatch.setattr(simhash, "stage", lambda df, name: seen.append((name, plan_of(df))) or stage(df, name))
    seen = []
    assert "BroadcastHashJoin [z" not in plan_of(simhash.fingerprint_links(nodes, 3, 2))
    assert [name for name, plan in seen] == ["entries", "buckets"] and "explode" not in seen[1][1]
