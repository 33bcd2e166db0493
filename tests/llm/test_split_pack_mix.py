import random

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import mix, pack, split

words = st.text(st.sampled_from("ab.!? \n\r#é́。、‍"), max_size=400)


@settings(max_examples=300, deadline=None)
@given(words, st.integers(1, 60), st.integers(0, 70))
def test_pieces_round_trip(text, limit, overlap):
    cuts = split.cut_points(text, limit, overlap)
    lap = max(0, min(overlap, limit - 1))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 <= e - s <= limit for s, e in cuts)
    assert all(b[0] == a[1] - lap and b[1] > a[1] for a, b in zip(cuts, cuts[1:]))
    assert text[: cuts[0][1]] + "".join(text[s + lap : e] for s, e in cuts[1:]) == text


def test_cuts_at_the_coarsest_pause():
    text = "a" * 30 + "\n\n" + "b b. " * 6 + "\n# Title\n" + "c" * 30
    (s, e), *_ = split.cut_points(text, 70, 5)
    assert text[e:].startswith("# Title")
    assert split.cut_points("x" * 10, 10, 3) == [(0, 10)] and len(split.cut_points("x" * 11, 10, 3)) == 2
    assert split.cut_points("", 10, 3) == [(0, 0)]


def test_split_frames(spark):
    rows = [("A", 1, "x" * 50, 0, "u"), ("a", 2, "y y " * 20, 0, "u"), ("a", 2, "y y " * 20, 0, "u"), ("b", 1, None, 1, "u"), ("c", 1, "z" * 40, None, None), ("d", 5, "q", 3, "u"), (None, 1, "n" * 99, 1, "u")]
    df = spark.createDataFrame(rows, "id string, updated_at int, content string, ordinal int, uri string")
    limits = spark.createDataFrame([("t", 40, 5)], "item_table string, max_chars int, overlap_chars int")
    p = split.split_oversized(df, "t", limits, "updated_at")
    assert {r.item_id for r in p.collect()} == {"a"}
    n = split.renumbered(df, p, "uri", "updated_at").orderBy("ordinal").collect()
    k = p.count()
    assert [r.ordinal for r in n if r.item_id in "abd"] == list(range(k + 2)) and [r.item_id for r in n][-1] == "d"
    assert split.split_oversized(df, "other", limits, None).count() == 0
    assert split.split_oversized(df.limit(0), "t", limits, "updated_at").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 64))
def test_bins_hold_every_item_once(sizes, capacity):
    bins = pack.best_two_fit(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= capacity for b in bins)


def test_packing_is_tight():
    rnd = random.Random(2)
    for sizes, least in (([rnd.randint(1, 512) for _ in range(20_000)], 0.985), ([min(512, int(rnd.lognormvariate(4.5, 1)) + 1) for _ in range(20_000)], 0.9995)):
        assert sum(sizes) / (len(pack.best_two_fit(sizes, 512)) * 512) > least


def test_pack_frames(spark):
    caps = spark.createDataFrame([("c", 10), ("d", 4)], "container string, capacity_tokens int")
    rows = [(i, s, "clash") for i, s in enumerate([10, 0, 25, 3, 3, 4, None, 7, 10])]
    items = spark.createDataFrame(rows, "doc_id long, size long, bin string")
    p = pack.pack_items(items, caps)
    for kind, cap in (("c", 10), ("d", 4)):
        rows = p.where(f"container = '{kind}'").collect()
        used, parts = {}, {}
        for r in rows:
            used[r.bin] = used.get(r.bin, 0) + r.size
            parts.setdefault(r.doc_id, []).append(r.size)
        assert max(used.values()) <= cap
        assert {k: sum(v) for k, v in parts.items()} == {0: 10, 1: 0, 2: 25, 3: 3, 4: 3, 5: 4, 7: 7, 8: 10}
        assert all(len(v) == max(1, -(-sum(v) // cap)) for v in parts.values())
    assert pack.pack_items(items.limit(0), caps).count() == 0 and pack.pack_items(items, caps.limit(0)).count() == 0
    assert {r.container for r in pack.pack_report(p).collect()} == {"c", "d"}


def test_flow_prefers_few_repeats():
    flows, met = mix.route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": (0.5, 3), "b": (0.5, 3)}, 200)
    assert met == 200
    assert sum(f for (_, use, _), f in flows.items() if use == 1) == 160
    assert mix.largest_total({("a",): 100, ("b",): 10}, {"a": (0.5, 1), "b": (0.4, 2), "gone": (0.1, 2)}) in range(49, 52)


def test_mix_frames(spark):
    rows = [(i, s, f"{s}{i}", 10 + i % 7) for i in range(600) for s in ("a" if i % 3 else "b",)]
    rows += [(1000 + i, "a", f"both{i}", 10) for i in range(50)] + [(2000 + i, "b", f"both{i}", 10) for i in range(50)]
    rows += [(3000 + i, "a", "hot", 5) for i in range(400)] + [(9000, "a", None, 4), (9001, None, "n", 4), (9002, "x", "n2", 4), (9003, "a", "zero", 0)]
    texts = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, key string, n_tokens long, use string")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.6, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn = mix.mix_sources(texts, targets, bucket_rows=50).collect()
    uses = {}
    key = {r[0]: r[2] for r in rows}
    for r in drawn:
        uses[key[r.doc_id]] = uses.get(key[r.doc_id], 0) + 1
    assert all(n <= (3 if k.startswith("b") and not k.startswith("both") else 1) for k, n in uses.items())
    rep = {r.source: r for r in mix.mix_report(spark.createDataFrame(drawn, mix.MIX), targets).collect()}
    assert rep["none"].actual_share == 0 and abs(rep["a"].actual_share - 1 / 3) < 0.02 and abs(rep["b"].actual_share - 2 / 3) < 0.02
    again = mix.mix_sources(texts, targets, bucket_rows=50).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    assert mix.mix_sources(texts.limit(0), targets).count() == 0 and mix.mix_sources(texts, targets.limit(0)).count() == 0
