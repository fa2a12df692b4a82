"""Near duplicates, top-k search, chat formatting and the pipeline against brute force."""

import hashlib
import json
import random

import pytest
from helpers import empty_documents, odd_documents, shingles
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from threadlens.llm import chat, mixing, neardup, topk


def brute_components(rows):
    """doc_id -> smallest reachable doc_id, from (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    least = {d: d for d, _ in rows}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * (len(x) + len(y) - both):
                lo, hi = sorted((root(a), root(b)))
                least[hi] = lo
    return {d: root(d) for d, _ in rows}


def family(rng, n, base, edit):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edit):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_ids_with_several_texts_lose_none(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(9000)}" for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (5, a), (5, b), (7, c), (7, b + " x"), (5, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in neardup.link(df).select("doc_id", "component_id", "kept").collect())
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (7, 7, True), (7, 5, False)])
    assert sorted(tuple(r) for r in neardup.one_of_each(df).collect()) == sorted([(1, a), (5, b), (7, c)])


def test_links_match_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for size, edit in ((40, 1), (40, 2), (30, 3), (30, 4), (25, 5)):
        texts += family(rng, size, [word() for _ in range(rng.randrange(60, 140))], edit)
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(60)]
    texts += texts[:30] + [texts[0].upper(), "a b", "A B", "a b c", "", None, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == k) and r["n_shingles"] == len(shingles(texts[k])) for k, r in got.items())


def test_few_partners_move_as_pairs(spark, monkeypatch):
    """Nodes of small bands that are similar but not enough to be linked come out once a pair, not once a band."""
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        texts += family(rng, 3, [f"w{rng.randrange(4000)}" for _ in range(150)], 4)
    rows, seen, keep = list(enumerate(texts)), {}, neardup.materialise

    def watched(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(neardup, "materialise", watched)
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    moved = [r.asDict() for r in seen["partnered"].collect()]
    assert moved and all(r["band"] is None and r["other"] is not None for r in moved) and len(moved) <= 3 * 12
    assert dict(seen["members"].dtypes) == {"node": "bigint", "band": "bigint"}


def test_component_stands_for_its_bands(spark, monkeypatch):
    """What lies next to a large component is compared with its nodes once, not once in each of the bands they share, and
    texts that share no band move no further."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = family(rng, 60, base, 1) + family(rng, 12, base, 4) + [" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    rows, seen, keep = list(enumerate(texts)), {}, neardup.materialise

    def watched(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(neardup, "materialise", watched)
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    whole = seen["groups"].where("whole")
    assert 0 < whole.count() == whole.select("band", "node").distinct().count() <= 72
    assert seen["groups"].count() * 3 < seen["apart"].count()
    assert seen["texts"].count() <= 72


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_estimate_is_near_the_similarity():
    rng = random.Random(1)
    for share in (0.3, 0.75, 0.95):
        n = 2000
        both = round(2 * n * share / (1 + share))
        common = [rng.getrandbits(64) for _ in range(both)]
        sets = [neardup.np.array(sorted(common + [rng.getrandbits(64) for _ in range(n - both)]), dtype="u8") for _ in range(2)]
        a, b = (neardup.signature(neardup.minima(s)) for s in sets)
        unequal = sum(bin((int(x ^ y) | int(x ^ y) >> 1) & 0x5555555555555555).count("1") for x, y in zip(a, b))
        assert (1 - unequal / neardup.HASHES - 0.25) / 0.75 == pytest.approx(share, abs=0.15)


def test_link_odd_rows(spark):
    docs = odd_documents(spark)
    got = neardup.link(docs).collect()
    assert len(got) == docs.count()
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] is not None)
    one = neardup.one_of_each(docs)
    assert one.columns == docs.columns
    assert one.count() == docs.count() - 1 and one.where("doc_id = 1").count() == 1
    assert neardup.link(empty_documents(spark)).count() == 0


def plain_code(v):
    return sum(1 << i for i, x in enumerate(v) if x > 0)


def test_top_k_matches_brute_force(spark):
    rng = random.Random(9)
    centre = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(i, [rng.gauss(0, 1) + (2 * c if i % 3 == 0 else 0) for c in centre]) for i in range(600)]
    rows += [(1000 + i, centre) for i in range(300)] + [rows[5]]
    df = spark.createDataFrame(rows + [(5000, None), (None, centre), (5001, [])], "id long, vector array<double>")
    queries = df.where("id % 50 = 0")
    got = {}
    for r in topk.search(df, queries, k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
    codes = {i: plain_code(v) for i, v in rows}
    for q in [i for i in codes if i % 50 == 0]:
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:10]
        assert got.pop(q) == want
    assert not got


def test_top_k_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0]), (2, [float("nan"), None])], "id long, vector array<double>")
    got = [(r["query_id"], r["rank"], r["id"], r["distance"]) for r in topk.search(df, df.where("id = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1), (0, 2, 2, 1)]
    none = df.where("id > 9")
    assert topk.search(none, none).count() == 0 and topk.search(df, none).count() == 0


def test_top_k_of_an_id_with_several_vectors(spark):
    flipped = lambda *bits: [-1.0 if i in bits else 1.0 for i in range(64)]
    rows = [(1, flipped()), *[(1, flipped(i)) for i in range(5)], (2, flipped(*range(6))), (3, flipped(*range(7)))]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    query = spark.createDataFrame([(1, flipped())], df.schema)
    got = [(r["rank"], r["id"], r["distance"]) for r in topk.search(df, query, k=2).orderBy("rank").collect()]
    assert got == [(1, 2, 6), (2, 3, 7)]


RECORDS = [
    ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"completion": "r", "prompt": "p", "other": [1]}, "prompt_completion", [("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": None, "output": "o"}, "instruction_input", [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages",
     [("system", "s"), ("user", "u")]),
    ({"id": 3, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations",
     [("user", "h"), ("assistant", "g")]),
    ({"unknown": 1}, None, [(None, None)]), ([1], None, [(None, None)]),
]


def test_json_layouts(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(90, None), (91, "{broken"), (None, "{}")]
    got = chat.json_turns(spark.createDataFrame(rows, "id long, raw string"), "id", "raw").orderBy("conv_id", "turn").collect()
    for i, (_, layout, turns) in enumerate(RECORDS):
        own = [r for r in got if r["conv_id"] == i]
        assert {r["layout"] for r in own} == {layout} and [(r["role"], r["text"]) for r in own] == turns
    assert sum(r["layout"] is None for r in got) == 5


def test_table_layouts(spark):
    nested = spark.createDataFrame([(1, [("user", "a"), ("assistant", None)])],
                                   "id long, messages array<struct<role: string, content: string>>")
    got = [(r["turn"], r["role"], r["text"]) for r in chat.table_turns(nested, "id").orderBy("turn").collect()]
    assert got == [(0, "user", "a"), (1, "assistant", "")]
    pairs = spark.createDataFrame([(1, "q", None)], "id long, question string, answer string")
    assert [tuple(r) for r in chat.table_turns(pairs, "id").collect()] == [(1, 0, "user", "q")]
    with pytest.raises(ValueError):
        chat.table_turns(spark.range(1), "id")


PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[:]", "[/ROLE]", "\\", "[", "<", "s>", "a", "\n", "é🙂"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escape_is_reversible(text):
    import re
    hidden = re.sub(chat.ESCAPE, r"\1\\\2\3", text)
    assert chat.unescape(hidden) == text
    assert not any(m in hidden for pair in [*chat.MARKS.values(), chat.OTHER] for m in pair)
    for begin, end in chat.MARKS.values():
        assert chat.parse(begin + hidden + end)[1] == text
    assert chat.parse(f"[ROLE]{hidden}[:]{hidden}[/ROLE]") == (text, text)


def test_read_back_digests(spark):
    rng = random.Random(4)
    rows = []
    for conv in list(range(12)) + [None]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "[:]"])
            text = rng.choice([None, "", "".join(rng.choices(PIECES, k=9)), "plain"])
            rows.append((conv, turn, role, text))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.table_turns(df, "conv_id", "turn"))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        g = got.pop(conv)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert g["n_turns"] == len(own) and g["loss_chars"] == len(loss)
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert not got
    assert chat.read_back(chat.format_turns(df.where("turn > 99"))).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_rules", "near_duplicates", "source_mixing", "window_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, sf).toArrow())
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "window_packing":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            want = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(seen[name]) == sorted(k for k, v in want.items() if k == v)
        if name == "source_mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert sorted(seen[name]) == sorted(k for k, n in copies.items() for _ in range(n))
    total = docs.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert total.where("n % doc_tokens <> 0").count() == 0 and set(seen["window_packing"]) == set(seen["source_mixing"])


def test_pipeline_of_odd_rows(spark):
    for docs in (odd_documents(spark), empty_documents(spark)):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, spark.createDataFrame(stage(spark, docs, "").toArrow())
        assert "sequence_id" in docs.columns


def test_layouts_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", "s", "p", "r")],
                               "conv_id long, turn long, role string, text string, system string, prompt string, response string")
    assert [tuple(r) for r in chat.table_turns(df, "conv_id", "turn").collect()] == [(1, 0, "user", "hi")]
    assert [tuple(r) for r in chat.table_turns(df, "conv_id").collect()] == [(1, 0, "user", "p"), (1, 1, "assistant", "r")]


def test_null_items_and_parts(spark):
    part = lambda t: {"type": "text", "text": t}
    records = [
        {"messages": [{"role": "user", "content": "a"}, None, {"role": "assistant", "content": None}]},
        {"messages": [{"role": "user", "content": [part("x"), part("y"), {"type": "image"}]}]},
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [part("z")]}]},
        {"messages": [{"role": "user", "content": {"deep": 1}}]},
        {"prompt": ["no"], "response": "text"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    got = chat.json_turns(spark.createDataFrame(rows, "id long, raw string"), "id", "raw").collect()
    told = {i: [(r["role"], r["text"]) for r in sorted((r for r in got if r["conv_id"] == i), key=lambda r: r["turn"] or 0)]
            for i in range(5)}
    assert told == {0: [("user", "a"), ("assistant", "")], 1: [("user", "xy")], 2: [("user", "q"), ("assistant", "z")],
                    3: [(None, None)], 4: [(None, None)]}
