"""Each operator against a plain version of it, and over rows that are easy to get wrong."""

import hashlib
import io
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import chat_format, exact_dedup, jaccard, mixing, packing, quality, queries, suffix_dedup, tokens, toxicity, url_filter
from tidewright.llm.common import utf8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, h long, ord long, kept boolean, _text string"
LONG = " ".join(f"word{i % 997}x{i % 13}" for i in range(40_000))
ODD = [None, "", " \n\t ", "a", "one two three four", "one two three four five", LONG, "the same text of more than five words here", "the same text of more than five words here", "é" * 300, "\\### x </turn>"]


def odd_rows(spark, ids=None):
    ids = ids or list(range(len(ODD)))
    rows = [(i, t, None, None if k % 3 else "s", None, 1, 2, 3, True, "z") for k, (i, t) in enumerate(zip(ids, ODD, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^ \t-\r]+", text or "")]


def shingles(text):
    w = words(text)
    return set(zip(*(w[j:] for j in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(sets):
        ids.setdefault(find(k), []).append(i)
    return sorted((i, len(s), min(x for x in ids[find(k)] if x is not None) if i is not None or s else None) for k, (i, s) in enumerate(sets))


def test_jaccard_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    rng = np.random.default_rng(3)
    base = words(rows[0][1])[:80]
    for k in range(60):  # chains of edits around one text, on both sides of the bound
        w = list(base)
        for _ in range(rng.integers(0, 9)):
            w[rng.integers(len(w))] = f"edit{rng.integers(6)}"
        rows.append((10_000 + k, " ".join(w)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == near_brute(rows)
    assert len({r["component_id"] for r in got}) < len(got) - 20


def test_jaccard_odd_rows(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd_rows(spark)).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3) and got[4] == (1, 4) and got[5] == (1, 5)
    assert got[7] == got[8] == (5, 7) and got[6][0] == len(shingles(LONG))
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    twice = jaccard.near_duplicates(odd_rows(spark, [5] * len(ODD))).collect()
    assert len(twice) == len(ODD) and {r["component_id"] for r in twice} == {5}
    assert jaccard.near_duplicates(odd_rows(spark, [None] * len(ODD))).count() == len(ODD)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\té", max_size=40), max_size=6))
def test_shingle_sets_are_those_of_the_words(texts):
    import pyarrow as pa

    values, off = jaccard.shingle_sets(*utf8(pa.array(texts, pa.string())))
    assert np.diff(off).tolist() == [len(shingles(t)) for t in texts]
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(frozenset(shingles(t)), set()).add(tuple(values[off[i] : off[i + 1]].tolist()))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=25))
def test_join_region_is_exact(found):
    sets = [np.array(sorted(s), np.uint64) for s in {frozenset(s) for s in found}]
    got = jaccard.join_region(sets, [s[: jaccard.prefix_size(len(s))] for s in sets])
    up = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
    assert len(set(zip(got, up, strict=True))) == len(set(got)) == len(set(up))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[200] == got[150] == got[100] == 100
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_brute(rows):
    seen, out = set(), []
    for i, t in rows:
        t = (t or "").encode()
        covered = bytearray(len(t))
        for p in range(len(t) - 99):
            if (w := t[p : p + 100]) in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for p in range(len(t)) if covered[p] and not (p and covered[p - 1]))
        out.append((i, len(t), sum(covered), spans, hashlib.sha256(bytes(c for c, f in zip(t, covered, strict=True) if not f)).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    passage = rows[3][1][:400]
    rows += [(10_000, passage * 3), (10_001, "x" * 99 + passage[50:250]), (10_002, "ab" * 700), (10_003, "é" * 200 + "ab" * 60), (10_004, "a" * 99), (10_005, "a" * 100), (10_006, "a" * 150), (10_007, "ab" * 300)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()
    assert sorted(tuple(r) for r in got) == repeats_brute(rows)


def test_repeats_odd_rows(spark):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(odd_rows(spark)).collect()}
    assert len(got) == len(ODD) and got[0]["n_bytes"] == 0 and got[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[9]["n_removed"] == 598 and got[6]["n_bytes"] == len(LONG)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    for ids in ([5] * len(ODD), [None] * len(ODD)):
        rows = suffix_dedup.remove_repeats(odd_rows(spark, ids)).collect()
        assert sorted(r["n_bytes"] for r in rows) == sorted(len((t or "").encode()) for t in ODD)
    same = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "y" * 50 + "z" * 80)] * 3, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in same) == [0, 130, 130]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(min_size=100, max_size=100)), min_size=2, max_size=12), st.integers(0, 4))
def test_common_prefixes(rows, cut):
    block = np.sort(np.array([r[0] for r in rows]))
    text = [b"q" * (cut * 20) + r[1][cut * 20 :] for r in rows]
    padded = np.frombuffer(b"".join(t + b"\0" * 4 for t in text), ">u8").reshape(len(rows), 13).astype(np.uint64)
    order, lcp = suffix_dedup.common_prefixes(block, padded)
    for i in range(1, len(rows)):
        a, b = order[i - 1], order[i]
        if block[a] != block[b]:
            assert lcp[i] == -1
        else:
            x, y = text[a] + b"\0" * 4, text[b] + b"\0" * 4
            n = next((k for k in range(104) if x[k] != y[k]), 104)
            assert x <= y and lcp[i] == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.binary(min_size=24, max_size=24), st.integers(0, 24)), min_size=2, max_size=25))
def test_interleave_merges_shards_as_a_sort_would(rows):
    group, shard = (np.array([r[i] for r in rows]) for i in range(2))
    words = np.frombuffer(b"".join(b"q" * r[3] + r[2][r[3] :] for r in rows), ">u8").reshape(len(rows), 3).astype(np.uint64)
    nth, own = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k in set(shard.tolist()):
        mine = np.flatnonzero(shard == k)
        order, lcp = suffix_dedup.common_prefixes(group[mine], words[mine])
        nth[mine[order]], own[mine[order]] = np.arange(len(mine)), lcp
    order, lcp = suffix_dedup.interleave(group, words, shard, nth, own)
    want, want_lcp = suffix_dedup.common_prefixes(group, words)
    assert (lcp == want_lcp).all() and (words[order] == words[want]).all() and (group[order] == group[want]).all()


def test_anchors_with_many_surroundings_are_split(spark, monkeypatch):
    """One passage of 60 bytes amid others, so that its anchor has many surroundings; and many copies of one text."""
    rng = np.random.default_rng(17)
    letters = np.array(list("abcdefghij "))
    some = lambda n: "".join(rng.choice(letters, n))
    passage, sides = some(60), [some(90) for _ in range(6)]
    rows = [(k, sides[rng.integers(6)] + passage + sides[rng.integers(6)] + some(30)) for k in range(60)]
    rows += [(100 + k, "same " + passage * 3 + "x" * (k % 3)) for k in range(20)]
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).drop("spans").collect()) == repeats_brute(rows)


def test_exact_dedup(spark):
    rows = odd_rows(spark, [5, 5, 2, None, None, 9, 10, 11, 12, 13, 14])
    for keep, best in (("min", min), ("max", max)):
        got = exact_dedup.exact_dedup(rows, keep=keep).collect()
        assert len(got) == len(ODD)
        for text, ids in {"": [5, 5], "the same text of more than five words here": [11, 12], "a": [None]}.items():
            mine = [r for r in got if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
            assert sorted((r["doc_id"] for r in mine), key=str) == sorted(ids, key=str) and sum(r["kept"] for r in mine) == 1
            assert all(r["group_size"] == len(ids) for r in mine) and {r["keep_id"] for r in mine} == {best((i for i in ids if i is not None), default=None)}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    assert exact_dedup.kept_documents(rows).count() == len({t or "" for t in ODD})
    assert exact_dedup.kept_documents(odd_rows(spark)).columns == rows.columns


def test_exact_dedup_survives_collisions(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lpad(F.hex(F.length(c)), 32, "0"))
    rows = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "x"), (5, "efg")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(rows).collect()}
    assert got == {1: (1, 2, True), 2: (2, 1, True), 3: (1, 2, False), 4: (4, 1, True), 5: (5, 1, True)}


def url_brute(url, rules):
    host, path = url_filter.split_url(url)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            key = (h.count("."), len(p))
            best = max(best or (key, verdict, rule), (key, verdict, rule))
    return best[1:] if best else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), st.tuples(st.sampled_from(["com", "a.com", "b.a.com", "net"]), st.sampled_from(["", "x", "x/", "x/y", "xy/"])).map("/".join)), max_size=6, unique_by=lambda r: r[1]), st.sampled_from(["com", "a.com", "A.com", "z.b.a.com", "nnet", "net"]), st.sampled_from(["", "/", "/x", "/x/", "/xy/z", "/x/y?q", "?x/", "#/x"]))
def test_url_trie(rules, host, tail):
    url = f"http://{host}{tail}"
    assert url_filter.Trie(rules).match(*url_filter.split_url(url)) == url_brute(url, rules)


def test_url_filter_odd_rows(spark):
    urls = [None, "", "no scheme", "://", "HTTP://WWW.Example.COM/en/x", "x://net/es", "x://net/es/?a#b", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5] == ("net", "/es", None, "allow")
    assert got[6] == ("net", "/es/", "net/es/", "block") and got[7] == ("b:", "//c/d", None, "allow")
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.Trie([("perhaps", "com/")])


def test_chat_round_trip(spark):
    texts = ["", "\\", "### user: x</turn>\n", "</turn>", "a\\</turn>\\", "é\n#", None]
    rows = [(1, i, "assistant" if i % 2 else "us:er\\#", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "assistant", "y")]
    messages = chat_format.fold_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.pieces(messages)).collect()}
    want = "".join(f"{'assistant' if i % 2 else 'us:er' + chr(92) + '#'}\n{t or ''}\n" for i, t in enumerate(texts))
    loss = "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert got[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1]["loss_chars"] == len(loss) and got[2]["n_turns"] == 2 and got[None]["loss_chars"] == 1
    for r in chat_format.render(messages).collect():
        turns = chat_format.read_back(r["formatted"])
        spoken = "".join(chat_format.unescape(r["formatted"][s["from"] : s["to"]]) for s in r["loss"])
        assert len(turns) == got[r["conv_id"]]["n_turns"] and len(r["formatted"]) == got[r["conv_id"]]["formatted_chars"]
        assert spoken == "".join(t for role, t in turns if role == "assistant")
    with pytest.raises(ValueError):
        chat_format.read_back("### user: x")


def test_chat_events_fold(spark):
    log = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "hel"), (1, 2, "delta", 1, None, "lo"), (1, 3, "edit", 0, None, "hi there"),
        (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, "assistant", "good "), (1, 6, "delta", 1, None, "day"), (1, 7, "message", 2, "user", "bye"), (1, 8, "delete", 2, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    out = chat_format.format_chat(df).collect()
    assert chat_format.read_back(out[0]["formatted"]) == [("user", "hi there"), ("assistant", "good day")]
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_mixing_keeps_every_prefix_within_a_block(spark):
    weights = {"a": 50, "b": 30, "c": 13, "d": 7}
    plan = {r["source"]: r for r in mixing.schedule(spark.createDataFrame(list(weights.items()), "source string, weight long")).collect()}
    slots = sorted((s, n) for n, r in plan.items() for s in r["slots"])
    assert [s for s, _ in slots] == list(range(100))
    done = dict.fromkeys(weights, 0)
    for t, (_, n) in enumerate(slots, 1):
        done[n] += 1
        assert all(abs(done[x] - w * t / 100) < 1 for x, w in weights.items())


def test_mixing_rows(spark):
    rows = odd_rows(spark)
    got = mixing.mix(rows, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(ODD))) and len({(r["mix_slot"], r["mix_rank"]) for r in got}) == len(ODD)
    own = spark.createDataFrame([("s", 3)], "source string, weight long")
    assert mixing.mix(rows, own).count() == len(ODD) and mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(odd_rows(spark, [None] * len(ODD))).count() == len(ODD)
    at = {r["doc_id"]: (r["mix_slot"], r["mix_rank"]) for r in got}
    order = [at[r["doc_id"]] for r in mixing.in_order(rows, 3, block_rows=2).collect()]
    assert order == sorted(order)


def test_mixing_leaves_columns_of_any_name_alone(spark):
    names = ["row", "key", "bucket", "n", "before", "nth", "block", "rank", "slot", "a", "q", "slots", "s", "c", "t", "_key", "mix_slot", "Mix_Rank", "x.y"]
    rows = spark.createDataFrame([(i, f"s{i % 3}", *[100 * i + k for k in range(len(names))]) for i in range(30)], ["doc_id", "source", *names])
    for out in (mixing.mix(rows, block_rows=4), mixing.in_order(rows, 3, block_rows=4)):
        kept = [c for c in rows.columns if c in out.columns and c != "mix_slot"]
        want = {tuple(r) for r in rows.select(*[f"`{c}`" for c in kept]).collect()}
        assert {tuple(r) for r in out.select(*[f"`{c}`" for c in kept]).collect()} == want
    assert mixing.in_order(rows, 3).columns == rows.columns
    assert [c for c in mixing.mix(rows).columns if c.lower().startswith("mix")] == list(mixing.ADDED)


def test_schedules_in_steps_and_of_any_length(spark, monkeypatch):
    weights = spark.createDataFrame([(f"s{i:02}", 1 + i * i % 7) for i in range(12)], "source string, weight long")
    whole = sorted(tuple(r) for r in mixing.schedule(weights).collect())
    monkeypatch.setattr(mixing, "STEP", 9)
    assert sorted(tuple(r) for r in mixing.schedule(weights).collect()) == whole
    common = weights.selectExpr("source", "weight * 50000 as weight")  # what all have in common makes no difference
    assert sorted(tuple(r) for r in mixing.schedule(common).collect()) == whole
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    rows = spark.range(500).selectExpr("id as doc_id", "concat('s', id % 3) as source")
    got = {r["doc_id"]: r["mix_slot"] for r in mixing.mix(rows, block_rows=8).collect()}
    monkeypatch.undo()
    assert got == {r["doc_id"]: r["mix_slot"] for r in mixing.mix(rows, block_rows=8).collect()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit(lengths):
    sizes = (8, 32, 64)
    opening = packing.opening_sizes(lengths, sizes, 5)
    bins, offsets, final, used = packing.best_fit(lengths, sizes, opening)
    inside = {}
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        inside.setdefault(b, []).append((o, n))
    for b, pieces in inside.items():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == used[b] <= final[b] and final[b] == min(s for s in sizes if s >= at)
    assert sum(used) == sum(lengths) and set(inside) == set(range(len(final)))


def best_fit_brute(lengths, sizes, size_of):
    """Contents of the bins, by looking through all of them."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        room = [(s - sum(c), i) for i, (s, c) in enumerate(open_) if s - sum(c) >= n]
        if room:
            least = min(r for r, _ in room)
            open_[max(i for r, i in room if r == least)][1].append(n)
        else:
            open_.append((size_of(n), [n]))
    return sorted(sum(c) for _, c in open_)


def bins_cost(used, sizes, overhead):
    return sum(overhead + min(s for s in sizes if s >= u) for u in used)


def least_cost(lengths, sizes, overhead):
    """Over all ways to put the pieces into bins."""
    best = [10**9]

    def put(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], bins_cost(bins, sizes, overhead))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= sizes[-1]:
                put(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        put(i + 1, [*bins, lengths[i]])

    put(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=7), st.integers(0, 12))
def test_sizes_are_chosen_jointly(lengths, overhead):
    sizes = (8, 16, 32)
    plan = packing.opening_sizes(lengths, sizes, overhead)
    ends = sorted(plan)
    size_of = lambda n: plan[next(e for e in ends if e >= n)]
    cost = packing.cost_of(sorted(lengths, reverse=True), sizes, plan, overhead)
    _, _, final, used = packing.best_fit(lengths, sizes, plan)
    assert cost == sum(overhead + s for s in final) == bins_cost(used, sizes, overhead) == bins_cost(best_fit_brute(lengths, sizes, size_of), sizes, overhead)
    for fixed in (lambda n: 32, lambda n: min(s for s in sizes if s >= n)):
        assert cost <= bins_cost(best_fit_brute(lengths, sizes, fixed), sizes, overhead)
    assert least_cost(lengths, sizes, overhead) <= cost <= 1.5 * least_cost(lengths, sizes, overhead)


def test_joint_sizes_beat_both_fixed_plans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    lengths = []
    for e in tokens.encoder_of(tokens.tokenizer_path()).encode([r["text"] for r in docs]):
        n = len(e) // 2 + 1
        lengths += [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0)
    ordered, sizes = sorted(lengths, reverse=True), packing.SIZES
    cost = packing.cost_of(ordered, sizes, packing.opening_sizes(lengths), packing.OVERHEAD)
    fixed = [packing.cost_of(ordered, sizes, {e: f(e) for e in packing.classes(sizes)}, packing.OVERHEAD) for f in (lambda e: 4096, lambda e: min(s for s in sizes if s >= e))]
    assert cost < min(fixed), (cost, fixed)


def test_pack_has_every_token_once(spark):
    path = tokens.tokenizer_path()
    lengths = {i: len(e) // 2 + 1 for i, e in enumerate(tokens.Encoder(path).encode(ODD))}
    got = packing.pack(odd_rows(spark), path, sizes=(16, 64, 256), window=7).collect()
    for i, n in lengths.items():
        pieces = sorted((r["piece"], r["piece_start"], r["n_tokens"]) for r in got if r["doc_id"] == i)
        assert [p[1] for p in pieces] == list(range(0, n, 256)) and sum(p[2] for p in pieces) == n
    by = {}
    for r in got:
        by.setdefault(r["bin_id"], []).append(r)
    assert all(sum(r["n_tokens"] for r in b) == b[0]["bin_used"] <= b[0]["bin_size"] for b in by.values())
    assert packing.pack(empty(spark), path).count() == 0 and packing.pack(odd_rows(spark, [None] * len(ODD)), path).where("doc_id is null").count() > 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA.,~ \n!'<|éΣ")), max_size=60), max_size=5))
def test_encoder_equals_whole_texts(texts):
    e = tokens.encoder_of(tokens.tokenizer_path())
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, e.width).tolist() for x in e.encode(texts)] == want


def test_records_round_trip(spark, data):
    path = tokens.tokenizer_path()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = sorted(tuple(r)[:4] for r in tokens.tokenize_documents(docs, path).collect())
    tokenizer, start = tokens.encoder_of(path).tokenizer, 0
    for (doc_id, at, n, crc), r in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert (doc_id, at, n, crc) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += n
    odd = tokens.tokenize_documents(odd_rows(spark, [3, 3, None, None, 1, 2, 5, 5, 5, 8, 9]), path).orderBy("start").collect()
    assert [r["doc_id"] for r in odd] == [None, None, 1, 2, 3, 3, 5, 5, 5, 8, 9] and tokens.tokenize_documents(empty(spark), path).count() == 0


def test_damaged_records_are_told():
    whole = tokens.frame(b"abc") + tokens.frame(b"")
    stream = io.BytesIO(whole)
    assert [tokens.read_frame(stream) for _ in range(3)] == [b"abc", b"", None]
    for at in (0, 9, 13, 16):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises((ValueError, OverflowError, MemoryError)):
            stream = io.BytesIO(bytes(bad))
            while tokens.read_frame(stream) is not None:
                pass
    with pytest.raises(ValueError):
        tokens.read_frame(io.BytesIO(whole[:10]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab# \n\té", max_size=80))
def test_quality_statistics(text):
    w = re.findall(r"[^ \t-\r]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    assert quality.statistics(text) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(marked))


def test_quality_keeps_good_rows_and_finds_bad_ones(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.judge_quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_on_rows_that_were_not_fitted_on(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = quality.judge_quality(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("not base_failed").collect()
    rows = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % quality.FOLDS == 0]
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 100 and sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 6)] * 3), min_size=2, max_size=30), st.integers(0, 5))
def test_forest_scores_are_those_of_a_walk_through_its_trees(rows, seed):
    x = np.array(rows, float)
    forest = quality.Forest.fit(x, trees=5, rows=16, seed=seed)
    want = []
    for row in x:
        total = 0.0
        for feature, cut, length in zip(forest.feature, forest.cut, forest.length, strict=True):
            k = 1
            while feature[k] >= 0:
                k = 2 * k + int(row[feature[k]] >= cut[k])
            total += length[k]
        want.append(2 ** (-total / 5 / forest.norm))
    assert np.allclose(forest.score(x), want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), max_size=40), st.sampled_from([0.0, 0.1, 0.3]))
def test_threshold_is_the_best_of_all(rows, loss):
    scores, good = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], bool)
    forest = quality.Forest.fit(np.zeros((2, 1)))
    forest.calibrate(scores, good, loss)

    def right(threshold):
        gone = scores > threshold
        return int((gone & ~good).sum() - (gone & good).sum()) if (gone & good).sum() <= loss * good.sum() else -1

    best = max((right(t) for t in [np.inf, *(scores - 0.5)]), default=0) if len(rows) and good.any() and not good.all() else 0
    assert right(forest.threshold) == max(best, 0)


def test_quality_odd_rows(spark):
    got = {r["doc_id"]: r for r in quality.judge_quality(odd_rows(spark), labels_of(spark)).collect()}
    assert len(got) == len(ODD) and not got[0]["kept"] and got[0]["n_words"] == 0 and got[6]["n_words"] == 40_000
    assert quality.judge_quality(empty(spark), labels_of(spark, [(1, None, None), (None, 1, 1)])).count() == 0


def test_toxicity_held_out(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    found = toxicity.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and sum(r["predicted"] == r["toxic"] for r in rows) >= 0.97 * len(rows)
    assert sum(r["predicted"] and not r["toxic"] for r in rows) <= 0.01 * len(rows)


def small_scorer():
    text = " ".join(["the moron and a stupid idiot or loser in that river of the other region was there"] * 30)
    s = np.array([0, *(toxicity._SYMBOL.get(c, 0) for c in text), 0])
    codes = s[:-2] * 4096 + s[1:-1] * 64 + s[2:]
    model = toxicity.CharModel.from_counts(codes, np.ones(len(codes)))
    bad = ("moron", "stupid", "idiot", "loser")
    return toxicity.Scorer(model, dict.fromkeys(bad, 6.0), dict.fromkeys(bad, -8.0))


@pytest.mark.parametrize("written", ["moron", "MORON!", "m0r0n", "m.o.r.o.n", "mooooron", "$tupid", "stup1d", "1d10t", "id!ot", "l0ser", "a m o r o n s", "x, l o s e r", "mоrоn", "i-d-i-o-t"])
def test_obfuscated_words_count(written):
    assert small_scorer().features(f"this is {written} here")[2] > 0


@pytest.mark.parametrize("written", ["more on", "maroon", "r2d2 and 1000", "stud", "l0l", "id", "closer", "a b c d e"])
def test_other_words_do_not_count(written):
    assert small_scorer().features(f"this is {written} here")[2] == 0


@pytest.mark.parametrize("written", ["m  o  r  o  n", "mo r on", "m\to\nr o n", "m\u03bfron", "\uff4d\uff4f\uff52\uff4f\uff4e", "\u039coron", "m o r 0 n", "m - o - r - o - n", "mo%ron", "m?oron"])
def test_spread_and_foreign_forms_count(written):
    assert small_scorer().features(f"this is {written} here")[2] > 0


def test_long_tokens_and_runs_are_decoded_whole():
    scorer = small_scorer()
    assert scorer.features("this is moro" + 70 * "o" + "n here")[2] > 0
    assert scorer.features("this is m" + 70 * "." + "oron here")[2] > 0
    assert scorer.features("x " + "q w " * 120 + "m o r o n s")[2] > 0
    assert toxicity.restore_words("m" + 70 * "." + "oron", scorer.model, {}) == ["moron"]
    letters = "theriverandthatregion" * 30
    assert toxicity.decode(toxicity.lattice(" ".join(letters)), scorer.model).replace(" ", "") == letters


@pytest.mark.parametrize("written", ["m,o,r,o,n", "m~o~r~o~n", "m#o#r#o#n", "m:o:r:o:n", "m|o|r|o|n", "m+o+r+o+n", "mo\u200bro\u200bn", "\u200bmoron", "i!d!i!o!t", "l0,s3r"])
def test_words_with_any_signs_inside_count(written):
    assert small_scorer().features(f"this is {written} here")[2] > 0


def paths_of(columns):
    paths = [("", 0.0)]
    for column in columns:
        paths = [(p + o, c + k) for p, c in paths for o, k in column]
    return paths


def rated(text, model, known):
    """The best rating of a text: each word between spaces by the known words' probabilities or by the letters."""
    best = {(0, 0): 0.0}
    parts = text.split(" ")
    for i, word in enumerate(parts):
        last, new = i + 1 == len(parts), {}
        for (a, b), s in best.items():
            x, y, t = a, b, s
            for z in [*(toxicity._SYMBOL.get(c, 0) for c in word), 0]:
                t += model.log_p[x, y, z]
                x, y = y, z
            new[x, y] = max(new.get((x, y), -1e9), t)
            if word in known:
                new[0, 0] = max(new.get((0, 0), -1e9), s + known[word])
        best = new if not last else {0: max(new.values())}
    return best[0]


@settings(max_examples=120, deadline=None)
@given(st.text("morn0!|ids 3.t", min_size=1, max_size=6), st.booleans())
def test_decode_is_the_best_of_all_paths(token, with_words):
    scorer = small_scorer()
    columns = toxicity.lattice(token.strip() or "m0")
    known = scorer.lexicon if with_words else None
    words = known.log_words if known else {}
    paths = paths_of(columns)
    best = max(rated(p, scorer.model, words) - c for p, c in paths)
    got = toxicity.decode(columns, scorer.model, known)
    assert max(rated(p, scorer.model, words) - c for p, c in paths if p == got) >= best - 1e-3


@settings(max_examples=100, deadline=None)
@given(st.text("morn0idt!|+.,~lse3$\u200bо ", min_size=1, max_size=10))
def test_scored_are_the_words_of_the_restored_text(token):
    scorer = small_scorer()
    text = toxicity.normal(f"the {token} there")
    words = toxicity.restore_words(text, scorer.model, {}, scorer.lexicon)
    assert sorted(scorer.found(text.split()).elements()) == sorted(w for w in words if w in scorer.weights)


def test_thresholds_come_from_inner_folds():
    rng = np.random.default_rng(2)
    toxic, fold, row, word = np.arange(300) % 3 == 0, np.arange(300) % 7 % toxicity.INNER, [], []
    for i in range(300):
        found = ([0] if toxic[i] else []) + [w for w in range(1, 40) if rng.random() < 0.02]  # words of either kind beside the toxic one
        row += [i] * len(found)
        word += found
    share, odds = toxicity.choose(toxic.astype(int), fold, np.full(300, 100), np.array(row), np.array(word), np.ones(len(row), int))
    assert share in toxicity.SHARES and odds in toxicity.ODDS
    bad, fine = np.array([100, 1, 2]), np.array([0, 5, 0])
    assert toxicity.in_lexicon(bad, toxicity.log_odds(bad, fine, (100, 200)), 100, share, odds).tolist() == [True, False, False]
    none = np.zeros(0, np.int64)
    assert toxicity.choose(np.array([0, 1]), np.array([0, 0]), np.ones(2), none, none, none) == (max(toxicity.SHARES), max(toxicity.ODDS))


def test_toxicity_odd_rows(spark):
    docs = odd_rows(spark)
    for labels in (labels_of(spark), labels_of(spark, [(3, 1, 1), (4, 1, 0), (None, 1, 1), (6, 1, None)])):
        got = toxicity.score_toxicity(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(empty(spark), labels_of(spark)).count() == 0
    held = {r["doc_id"]: r["held_out"] for r in toxicity.score_toxicity(docs, labels_of(spark)).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 103, n, dtype=np.uint8)).replace(b"c", b" ") for n in (5000, 0, 30, 99, 100, 101, 900, 4000)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    values, sizes = jaccard.shingle_sets(data, off)
    whole = suffix_dedup.anchors(data, off)

    def windows(found):
        return sorted((t, p - a, p, h) for t, p, h, near, far in zip(*(x.tolist() for x in found), strict=True) for a in range(near, far + 1))

    for size in (150, 777):
        monkeypatch.setattr(jaccard, "SLICE", size)
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        again = jaccard.shingle_sets(data, off)
        assert (again[0] == values).all() and (again[1] == sizes).all()
        assert windows(suffix_dedup.anchors(data, off)) == windows(whole)
    assert len(windows(whole)) == sum(max(0, len(t) - 99) for t in texts)


def test_large_regions_are_split_exactly(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for c in range(3):
        base = [f"c{c}w{i}" for i in range(70)]
        for _ in range(70):
            w = list(base)
            for _ in range(rng.integers(0, 7)):
                w[rng.integers(len(w))] = f"edit{rng.integers(4)}"
            rows.append((k, " ".join(w)))
            k += 1
    want = near_brute(rows)
    for sets, size, pivots in ((15, 1 << 26, 8), (1000, 8000, 4)):
        monkeypatch.setattr(jaccard, "REGION_SETS", sets)
        monkeypatch.setattr(jaccard, "REGION_BYTES", size)
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(tuple(r) for r in got) == want, (sets, size, pivots)
    assert 3 < len({c for *_, c in want}) < len(want) - 60


def test_regions_without_near_pivots_are_split_by_shingles(spark, monkeypatch):
    """Texts that share passages, so that all are one region, but most of which are far from each other."""
    rng = np.random.default_rng(13)
    passages = [[f"p{i}w{j}" for j in range(9)] for i in range(14)]
    rows = [(k, " ".join(w for i in rng.choice(14, 5, replace=False) for w in passages[i])) for k in range(60)]
    rows += [(100 + k, f"{rows[k][1]} tail{k}") for k in range(0, 60, 4)] + [(200 + k, f"x{k} {rows[k][1]}") for k in range(0, 60, 6)]
    want = near_brute(rows)
    split = []
    plain = jaccard.split_by_shingles
    monkeypatch.setattr(jaccard, "split_by_shingles", lambda *a: split.append(1) or plain(*a))
    monkeypatch.setattr(jaccard, "REGION_SETS", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == want and split
    assert len({c for *_, c in want}) < len(want) - 15


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(1, 25), min_size=1, max_size=14), min_size=2, max_size=25))
def test_shingle_prefixes_of_any_depth_hold_linked_pairs(found):
    """Of linked sets the first k common shingles stand among the first n - overlap + k of each."""
    sets = [sorted(x) for x in {frozenset(x) for x in found}]
    for a, b in combinations(sets, 2):
        both = sorted(set(a) & set(b))
        if 100 * len(both) >= 80 * len(set(a) | set(b)):
            for k, s in enumerate(both, 1):
                assert all(x.index(s) < len(x) - jaccard.overlap_size(len(x)) + k for x in (a, b))


def test_counts_round_trip():
    h = np.sort(np.random.default_rng(1).integers(0, 500, 900).astype(np.uint32))
    found, n = jaccard.from_counts(jaccard.to_counts(h))
    assert (np.repeat(found, n) == h).all() and len(jaccard.from_counts(jaccard.to_counts(h[:0]))[0]) == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["message", "delta", "edit", "regenerate", "delete", None]), st.integers(0, 3), st.sampled_from(["a", "b#", None])), min_size=1, max_size=14))
def test_chat_events_against_a_plain_fold(spark, log):
    """One event after the other, over the turns of one conversation."""
    turns = {}
    for kind, turn, text in log:
        text = text or ""
        if kind in ("message", None, "edit"):
            turns[turn] = text
        elif kind == "delta":
            turns[turn] = (turns.get(turn) or "") + text
        elif kind == "regenerate":
            for t in [t for t in turns if t >= turn]:
                del turns[t]
    gone = {t for k, t, _ in log if k == "delete"}
    rows = [(7, i, k, t, "user", x) for i, (k, t, x) in enumerate(log) if t not in gone or k == "delete" or k == "regenerate"]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = {r["turn"]: r["text"] for r in chat_format.fold_events(df).collect()}
    assert got == {t: x for t, x in turns.items() if t not in gone}


def test_url_filter_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "x://net/es/", 5, 6, 7)], ["page_id", "url", "_judged", "judged_", "a.b"])
    row = url_filter.filter_urls(pages, queries.URL_RULES).collect()[0]
    assert (row["_judged"], row["judged_"], row["a.b"], row["verdict"]) == (5, 6, 7, "block")


def test_other_vocabularies_are_encoded_by_whole_texts():
    texts = ["Two  words, it's\n\n ~ end", None, " a~b ~", "x" * 50 + " \u4e2d"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = tokens.Encoder(tokens.tokenizer_path(name))
        want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [np.frombuffer(x, e.width).tolist() for x in e.encode(texts)] == want
        assert e.by_words == (name == "word_bpe_49k.json")
