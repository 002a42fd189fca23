"""Every operator against brute force and on odd input: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SPACE = r"[^\x20\x09-\x0D]+"


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    base = [[r.choice(vocabulary) for _ in range(r.randint(0, 90))] for _ in range(n // 3)]
    texts = []
    for k in range(n):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 9])):
            if words:
                words[r.randrange(len(words))] = r.choice(vocabulary)
        if k % 7 == 0:
            words += r.choice(base)[:40]
        texts.append(" ".join(words))
    return texts + [None, "", "  \n", "one", "One", "one two three", "é è 中 a b c", " ".join(["ha"] * 70), " ".join(vocabulary * 60)]


def word_lists(texts, lower):
    return [re.findall(SPACE, (t or "").translate(LOWER) if lower else (t or "")) for t in texts]


def test_jaccard_classes_match_brute_force(spark, docs_of):
    from millrace.llm.ngram_join import jaccard_classes

    texts = corpus(1)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in word_lists(texts, True)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for options in ({}, {"hot": 1, "sketch": 1 << 13}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(spark, docs_of(texts), **options).collect()}
        assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_jaccard_classes_of_nothing_and_of_repeated_rows(spark, docs_of):
    from millrace.llm.ngram_join import jaccard_classes

    assert jaccard_classes(spark, docs_of([])).count() == 0
    rows = jaccard_classes(spark, docs_of(["a b c d e f"] * 3 + [None], [4, 4, 2, None])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(2, 2), (4, 2), (4, 2)]


def cut(texts, k=20):
    words = word_lists(texts, False)
    seen, gone = set(), [set() for _ in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if key in seen:
                gone[d].update(range(i, i + k))
            seen.add(key)
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone, strict=True)]


@pytest.mark.parametrize("block_words", [1_500_000, 400, 3])
def test_repeats_match_brute_force(spark, docs_of, block_words):
    from millrace.llm.substring_dedup import remove_repeats

    texts = corpus(2)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(spark, docs_of(texts), block_words=block_words).collect()}
    assert got == dict(enumerate(cut(texts)))


def test_repeats_of_odd_rows(spark, docs_of):
    from millrace.llm.substring_dedup import remove_repeats

    assert remove_repeats(spark, docs_of([])).count() == 0
    same = " ".join(f"w{i}" for i in range(30))
    rows = remove_repeats(spark, docs_of([same, same, same, None], [5, 5, None, 1]), carry=["kept", "z"]).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"], r["carry"]["z"]) for r in rows) == [(1, 0, "z"), (5, 0, "z"), (5, 0, "z"), (99, 30, "z")]


def test_recompression_is_consistent_inside():
    from millrace.llm.substring_dedup import recompress
    from millrace.llm.words import mix

    r = np.random.default_rng(4)
    same = r.integers(0, 9, 60)
    found = []
    for left, right in ((7, 3), (0, 11), (20, 0)):
        seq = mix(np.r_[r.integers(0, 9, left), same, r.integers(0, 9, right)].astype(np.uint64))
        name, lo, hi = recompress(seq, np.array([0, len(seq)]))
        inside = (lo >= left) & (hi <= left + len(same))
        found.append([(int(n), int(a) - left, int(b) - left) for n, a, b in zip(name[inside], lo[inside], hi[inside], strict=True)])
    assert len(found[0]) > 3 and found[0] == found[1] == found[2] or set(found[0]) & set(found[1]) & set(found[2])


def hits(texts, items, n=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lists = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
    windows = defaultdict(set)
    for item, t in items:
        w = re.findall(pattern, (t or "").translate(LOWER))
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[i : i + m])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for w in lists:
        covered, own = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if found := windows.get(tuple(w[i : i + m])):
                    covered.update(range(i, i + m))
                    own |= found
        out.append((len(w), len(covered), sorted(own)))
    return out


@pytest.mark.parametrize("most_bytes", [8 << 20, 60])
def test_contamination_matches_brute_force(spark, docs_of, most_bytes):
    from millrace.llm.decontaminate import find_contamination

    texts = corpus(3)
    items = [(7, texts[2]), (8, texts[5]), (8, "au av; AW ax!"), (10, "au"), (11, None), (12, " - "), (13, "one-two THREE"), (7, texts[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in find_contamination(spark, docs_of(texts), bench, most_bytes=most_bytes).collect():
        got[r["doc_id"]] = (r["n_words"], sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)), list(r["items"]))
    assert got == dict(enumerate(hits(texts, items)))
    assert find_contamination(spark, docs_of([]), bench).count() == 0
    none = find_contamination(spark, docs_of(["a"]), bench.limit(0), carry=["score"]).first()
    assert none["items"] == [] and none["carry"]["score"] == "s"


def test_packing_round_trip(spark, docs_of):
    from tokenizers import Tokenizer

    from millrace.llm.packing import pack
    from millrace.llm.queries import tokenizer_path

    texts = [*corpus(5), "a<|endoftext|>b <|STARTOFTEXT|>", "İ É don't 12 ²!", "word " * 5000, "word " * 2047]
    rows = pack(spark, docs_of(texts), tokenizer_path(), with_ids=True).collect()
    t = Tokenizer.from_file(tokenizer_path())
    for d, group in itertools.groupby(sorted(rows, key=lambda r: (r["doc_id"], r["piece"])), lambda r: r["doc_id"]):
        group = list(group)
        ids = t.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        assert [x for r in group for x in r["ids"]] == ids
        assert [r["start"] for r in group] == list(range(0, len(ids), 2048)) and all(r["length"] == 2048 for r in group[:-1])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in group)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        at = 0
        for r in group:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert pack(spark, docs_of([]), tokenizer_path()).count() == 0


def test_packing_plan_is_near_the_bound():
    from millrace.llm.packing import best_fit, solve

    r = random.Random(6)
    for histogram in ({r.randint(1, 100): r.randint(1, 400) for _ in range(60)}, {60: 100}, {51: 10, 49: 9}, {100: 5}, {1: 1}):
        plan = solve(histogram, 100, steps=150)
        used = Counter()
        for config, times in plan:
            assert sum(config) <= 100 and times > 0
            for k in config:
                used[k] += times
        assert used == Counter(histogram)
        bins = sum(t for _, t in plan)
        bound = max(math.ceil(sum(k * n for k, n in histogram.items()) / 100), sum(n for k, n in histogram.items() if k > 50))
        assert bound <= bins <= sum(t for _, t in best_fit(histogram, 100)) + 1


def test_quality_learns_from_pairs(spark, docs_of):
    from millrace.llm.quality import fit, score_quality

    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    good = [". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(6)) for _ in range(120)]
    bad = [" | ".join(word().upper() + "!!" for _ in range(50)) for _ in range(120)]
    texts = good + bad + [None, "", "x " * 50_000]
    labels = spark.createDataFrame([(k, int(k < 120), 0) for k in range(240)] + [(None, 1, 0), (3, None, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["score"] for x in score_quality(spark, docs_of(texts), labels, carry=["score"]).select("doc_id", "score").collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum((got[k] >= 0.5) == (k < 120) for k in held) >= 0.95 * len(held)
    assert score_quality(spark, docs_of([]), labels).count() == 0
    assert {x["score"] for x in score_quality(spark, docs_of(["a", None]), labels.limit(0)).collect()} == {0.5}
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    assert (fit(x, np.array([0, 0, 1, 1])).score(x) >= 0.5).tolist() == [False, False, True, True]


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site, name.</p></header><nav><ul><li><a href=/a>A</a><li>B</ul></nav>
<div class="cookie-notice"><p>We use cookies, always.</p></div><article><h1>Head &amp; more</h1><p>First, one&nbsp;two<br>three; a sentence that is long enough, really.<p>Second <b>bold, text</b>: it goes
on and on, with marks. And more!</p><aside>Side, note.</aside><form><p>Name, please.</p></form></article><div id=comments><p>Great, post!</p></div><footer>&copy; 2024, all rights.</footer></body></html>"""


def test_html_content():
    from millrace.llm.html_extract import content_blocks

    assert content_blocks(PAGE) == ["Head & more", "First, one two three; a sentence that is long enough, really.", "Second bold, text: it goes on and on, with marks. And more!"]
    assert content_blocks(None) == content_blocks("") == content_blocks("<nav>a</nav>") == content_blocks("<script>x") == []
    assert content_blocks("plain, text") == ["plain, text"]
    assert content_blocks("<p>a<p>b</div></p><<>") != []
    assert len(content_blocks("<div>" * 5000 + "<p>deep, text.</p>")) == 1


LINES = [f"Line {k}, of an article; it says something, and then it goes on for a while." for k in range(20)]


def test_html_keeps_chosen_text_outside_the_container():
    from millrace.llm.html_extract import content_blocks

    p = [f"<p>{x}</p>" for x in LINES]
    nav = "<nav><a href=/>a</a></nav><div><a>more</a></div>"
    assert content_blocks(f"<body>{nav}<article><section>{''.join(p[:3])}</section><section>{''.join(p[3:])}</section></article>") == LINES
    assert content_blocks(f"<body>{nav}<div>{p[0]}<blockquote>{''.join(p[1:19])}</blockquote>{p[19]}</div>") == LINES


def test_html_names_do_not_discard_the_article():
    from millrace.llm.html_extract import content_blocks

    p = "".join(f"<p>{x}</p>" for x in LINES)
    ad = '<div class="ad"><p>Buy this, now; it is cheap, and good.</p></div>'
    for wrap in ('class="content-sidebar-wrap"', 'class="layout has-sidebar"', 'class="article no-comments"', 'title="the hidden truth"', 'data-x=" hidden "'):
        assert content_blocks(f"<body>{ad}<div {wrap}>{p}{ad}</div>") == LINES
    posts = "".join(f'<div class="social-post"><p>{x}</p></div>' for x in LINES)
    assert content_blocks(f"<body>{posts}") == LINES
    for hide in ("hidden", "HIDDEN=''", "style='display: none'", "aria-hidden=true"):
        assert content_blocks(f"<body><div {hide}>{p}</div><p>a, b.</p>") == ["a, b."]


def test_html_extract(spark):
    from millrace.llm.html_extract import extract

    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (1, "u", PAGE, "x"), (None, "u", "", "z")], "page_id long, url string, html string, text string")
    got = extract(spark, rows).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[0] == (0, 0) and len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(spark, rows.limit(0)).count() == 0


def test_nearest_recall(spark):
    from millrace.llm.ann import nearest

    r = np.random.default_rng(8)
    centres = r.normal(size=(8, 16))
    x = np.concatenate([centres[r.integers(0, 8, 700)] + 0.3 * r.normal(size=(700, 16)), r.normal(size=(200, 16))])
    x[5] = x[6] = x[7]
    x[40] = 0
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(2000, None, 1), (2020, [float("nan")] * 16, 1), (2040, [1.0], 1), (2060, [None] * 16, 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for row in sorted(nearest(spark, df).collect(), key=lambda q: (q["query_id"], q["rank"])):
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    live = np.array([i for i in range(900) if i != 40])
    assert sorted(got) == [i for i in live.tolist() if i % 20 == 0]
    found = 0
    for q, pairs in got.items():
        s = x[live] @ x[q]
        s[live == q] = -np.inf
        best = live[np.lexsort((live, -s))][:20]
        found += len({v for v, _ in pairs} & set(best.tolist()))
        assert len(pairs) == 20 and [p[1] for p in pairs] == sorted((p[1] for p in pairs), reverse=True)
        assert all(abs(sc - x[q] @ x[v]) < 1e-9 for v, sc in pairs)
    assert found >= 0.9 * 20 * len(got)
    assert nearest(spark, df.limit(0)).count() == 0
    assert [(r["query_id"], r["vec_id"]) for r in nearest(spark, df.where("vec_id in (20, 21)")).collect()] == [(20, 21)]


def test_index_finds_every_code_in_the_radius():
    from millrace.llm.ann import Index

    r = np.random.default_rng(9)
    codes = r.integers(0, 1 << 63, (400, 8), dtype=np.uint64)
    codes[:200] = codes[0]
    for k in range(200):
        codes[k, r.integers(0, 8, k % 9)] ^= np.uint64(1) << r.integers(0, 63, k % 9).astype(np.uint64)
    index = Index(codes)
    for radius in (0, 1, 3, 8, 230, 512):
        near = np.flatnonzero(np.bitwise_count(codes ^ codes[0]).sum(1) <= radius)
        found = index.within(index.parts(codes[0]), radius)
        assert set(near.tolist()) <= set(found.tolist())
    assert len(index.within(index.parts(codes[0]), 8)) == 200


def test_nearest_on_the_whole_table_by_a_small_share_of_codes(data):
    """Recall against brute force on the real table, and how much of it probing retrieves."""
    import pyarrow.parquet as pq

    from millrace.llm import ann

    table = pq.read_table(f"{data.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet")
    ids, x = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), np.float64)
    model = ann.Codes(x, float(np.sqrt((x**2).sum(1)).max()))
    asked = np.flatnonzero(ids % 20 == 0)
    bound, index, codes = ann.bounds((ids, x), ids[asked], x[asked], 20, len(x)), ann.Index(model.encode(x)), model.encode(x[asked], True)
    found, share = 0, 0
    for k, at in enumerate(asked):
        rows, _, got = ann.search(index, ids, x, model, int(ids[at]), x[at], codes[k], 20, bound[k])
        score = x @ x[at]
        score[at] = -np.inf
        found += len(set(rows.tolist()) & set(np.lexsort((ids, -score))[:20].tolist()))
        share += got / len(x)
    assert found >= 0.9 * 20 * len(asked) and share < 0.3 * len(asked)


def test_nearest_ties_and_repeated_ids(spark):
    from millrace.llm.ann import nearest

    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), *((k, [0.5, 0.5]) for k in range(1, 31) if k != 20), *((k, [-1.0, -1.0]) for k in range(31, 39))]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect())
    assert [r for r, *_ in got] == [1, 2, 3, 4, 5] and all(s == 0.5 for *_, s in got) and {v for _, v, _ in got} <= {1, 2, 3, 4, 5}


def test_min_cost_flow():
    from millrace.llm.reshard import min_cost_flow

    flow = min_cost_flow([10, 0, 5], [5, 5, 5], [[0, 1, 1], [1, 0, 1], [1, 1, 0]])
    assert flow == [[5, 5, 0], [0, 0, 0], [0, 0, 5]]
    flow = min_cost_flow([4, 4], [4, 4], [[1, 5], [1, 9]])
    assert sum(f * c for row, cost in zip(flow, [[1, 5], [1, 9]], strict=True) for f, c in zip(row, cost, strict=True)) == 24
    with pytest.raises(ValueError):
        min_cost_flow([2], [1], [[0]])


def test_resharding(spark, docs_of, tmp_path):
    from millrace.llm.reshard import place, rewrite

    texts = [f"text {k} " * (k % 9) for k in range(400)] + ["same text"] * 30 + [None, None, ""] + ["hot"] * 300
    docs = docs_of(texts)
    placed = place(spark, docs, shards=4, cells=64, keep=["doc_id", "text", "score"])
    rows = placed.collect()
    size = {k: len((t or "").encode()) + 16 for k, t in enumerate(texts)}
    assert all(r["size"] == size[r["doc_id"]] and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows) and len(rows) == len(texts)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= 40
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert len({r["shard"] for r in rows if texts[r["doc_id"]] == "same text"}) == 1
    changed = rewrite(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == sum(r["shard"] in changed for r in rows) and set(back.columns) == {"slot", "doc_id", "text", "score", "shard"}
    assert place(spark, docs_of([])).count() == 0


def test_equal_texts_stay_together_up_to_a_shard(spark, docs_of):
    from millrace.llm.reshard import place

    texts = ["half a shard"] * 150 + ["a shard and more"] * 500 + [f"text {k} " * (1 + k % 5) for k in range(900)] + [None, None]
    placed = place(spark, docs_of(texts, [*range(1549), None, 7, 7]), shards=4, cells=64).collect()
    load = Counter()
    for r in placed:
        load[r["shard"]] += r["size"]
    assert len(placed) == len(texts) and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values())
    assert len({r["shard"] for r in placed if r["text_crc32"] == zlib.crc32(b"half a shard")}) == 1
    assert len({r["shard"] for r in placed if r["text_crc32"] == zlib.crc32(b"a shard and more")}) > 1
    for s in range(4):
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed)))


def test_flow_moves_the_fewest_bytes_of_all_plans():
    from millrace.llm.reshard import min_cost_flow

    r = random.Random(5)
    for _ in range(30):
        supply = [r.randint(0, 4) for _ in range(3)]
        total = sum(supply)
        capacity = [total // 3 + (j < total % 3) for j in range(3)]
        plans = itertools.product(*[[p for p in itertools.product(range(s + 1), repeat=3) if sum(p) == s] for s in supply])
        least = min(sum(f for i, p in enumerate(plan) for j, f in enumerate(p) if i != j) for plan in plans if all(sum(p[j] for p in plan) <= capacity[j] for j in range(3)))
        flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(3)] for i in range(3)])
        assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == least


def test_bradley_terry_fit_matches_plain_gradient_steps():
    from millrace.llm.quality import fit

    r = np.random.default_rng(2)
    x = r.normal(size=(60, 3)) + np.repeat([[0.0], [0.8]], 30, 0)
    y = np.repeat([0, 1], 30)
    model = fit(x, y)
    z = (x - model.mean) / model.scale
    # pairs of every label-1 row over every label-0 row, by small steps on the logistic loss
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    w = np.zeros(3)
    for _ in range(4000):
        w += 0.1 * (d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w)
    assert np.linalg.norm(w - model.weights) < 0.05 * np.linalg.norm(w)
    # the threshold is the quantile at which the share of label 0 lies below
    worth = np.sort(model.worth(x))
    assert worth[29] <= model.threshold <= worth[30]


def test_language_fusion(spark):
    from millrace.llm.language import declared, identify

    a, b = "der und das nicht ein ", "the and of that is "
    labelled = spark.createDataFrame([(k, (a if k % 2 else b) * 5, "de" if k % 2 else "en", f"h{k % 2}") for k in range(60)] + [(100, None, "de", None), (101, "", None, "h1")], "doc_id long, text string, lang string, source string")
    pages = [(1, "http://www.x.de/1", f'<html lang="de"><p>{a * 4}</p>'), (2, "http://www.x.de/2", '<html lang="de"><p></p>'), (3, None, None), (4, "http://y.com/", f"<p>{b * 4}</p>"), (5, "http://www.x.de/5", f"<p>{a}</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r["doc_id"], r["page_id"]): r["lang"] for r in identify(spark, labelled, documents=labelled, pages=df).collect()}
    assert len(got) == 67 and all(got[k, None] == ("de" if k % 2 else "en") for k in range(60))
    assert got[None, 1] == got[None, 2] == got[None, 5] == "de" and got[None, 4] == "en" and got[101, None] == "de" and got[None, 3] in ("de", "en")
    assert identify(spark, labelled, documents=labelled.limit(0)).count() == 0
    assert {r["lang"] for r in identify(spark, labelled.limit(0), documents=labelled).collect()} == {None}
    assert declared("<HTML xml:lang='fr-CA'>") == "fr" and declared(None) is None


def test_declared_language_has_no_reach():
    from millrace.llm.language import declared

    long = "x = 1; " * 20_000
    assert declared(f'<!-- {long} --><html lang="de-AT"><p>a') == "de"
    for meta in ('<meta property="og:locale" content="fr_FR">', '<meta content="fr" http-equiv="Content-Language">'):
        assert declared(f"<html><head><script>{long}</script><style>{long}</style>{meta}</head><body>") == "fr"
    # what only looks like markup declares nothing
    assert declared("""<!-- <html lang="en"> --><script>s = '<html lang="en">'</script><html data-lang='en' lang=de>""") == "de"
    assert declared("<html <meta <html " * 1000) is declared("<!--") is declared("<script>") is declared("<html lang=''>") is None


def test_every_label_language_is_learned(spark):
    from millrace.llm.language import _quota, identify, train

    word = lambda k: "".join(chr(97 + (k // d) % 26) for d in (1, 26, 26 * 26)) * 2
    rows = [(k, " ".join(f"{word(31 * (k % 70))} q{word(31 * (k % 70))}" for _ in range(30)), f"l{k % 70:02}", None) for k in range(700)]
    labelled = spark.createDataFrame([*rows, *[(1000 + k, "ab cd ef", "big", None) for k in range(3000)]], "doc_id long, text string, lang string, source string")
    languages, tables = train(spark, labelled, most_rows=500, least_rows=2)
    assert languages == ["big", *[f"l{k:02}" for k in range(70)]] and (tables.max(1) > tables.min(1)).all()
    got = identify(spark, labelled, documents=labelled).collect()
    assert all(r["lang"] == ("big" if r["doc_id"] >= 1000 else f"l{r['doc_id'] % 70:02}") for r in got) and len(got) == 3700
    assert _quota([5, 1000, 1000], 105) == 50 and _quota([5, 6], 100) == 6 and _quota([3] * 10, 5) == 1


def test_hmm_recursions_match_enumeration():
    from millrace.llm.hmm import _STRETCH, Model, expected_counts, log_likelihood

    r = np.random.default_rng(10)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = Model(norm(r.random(2)), norm(r.random((2, 2))), norm(r.random((2, 3))))
    seqs = [[0], [1, 2, 0], [2, 2, 1, 0, 1]]
    first, symbols = np.r_[0, np.cumsum([len(s) for s in seqs])], np.concatenate(seqs)
    counts = np.zeros(2 + 4 + 6)
    for k, s in enumerate(seqs):
        total, own = 0.0, np.zeros_like(counts)
        for path in itertools.product(range(2), repeat=len(s)):
            p = m.start[path[0]] * math.prod(m.move[a, b] for a, b in itertools.pairwise(path)) * math.prod(m.emit[a, o] for a, o in zip(path, s, strict=True))
            total += p
            own[path[0]] += p
            for a, b in itertools.pairwise(path):
                own[2 + 2 * a + b] += p
            for a, o in zip(path, s, strict=True):
                own[6 + 3 * a + o] += p
        counts += own / total
        assert abs(log_likelihood(m, first, symbols)[k] - math.log10(total)) < 1e-9
    assert np.allclose(expected_counts(m, first, symbols), counts)
    long = r.integers(0, 3, 5 * _STRETCH + 17)
    a, want = m.start * m.emit[:, long[0]], 0.0
    for o in long[1:]:
        want += math.log10(a.sum())
        a = (a / a.sum() @ m.move) * m.emit[:, o]
    assert abs(log_likelihood(m, np.array([0, len(long)]), long)[0] - want - math.log10(a.sum())) < 1e-8


def test_hmm_base_scores(spark, docs_of):
    from millrace.llm.hmm import score_texts

    texts = corpus(11)
    tokens = [[*w, None] for w in word_lists(texts, True)]
    c = Counter(t for k, w in enumerate(tokens) if zlib.crc32(str(k).encode()) % 7 != 2 for t in w)
    n, v = sum(c.values()), len(c)
    for options in ({}, {"frequent": 4, "vocabulary": 3, "states": 2}):
        rows = score_texts(spark, docs_of(texts), **options).collect()
        assert len(rows) == len(texts)
        for r in rows:
            w = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[t] > 0 for t in w), n)
            assert abs(r["base_score"] - sum(math.log10((c[t] + 1) / (n + v + 1)) for t in w)) < 1e-6 and r["score"] < 0
    assert score_texts(spark, docs_of([])).count() == 0
    odd = score_texts(spark, docs_of(["a b", "a b", None], [None, 1, 1])).collect()
    assert len(odd) == 3 and all(math.isfinite(r["score"]) for r in odd)


def test_hmm_trains_on_all_texts_to_convergence(spark, docs_of, monkeypatch):
    from millrace.llm import hmm

    r = np.random.default_rng(3)
    m = hmm.Model(np.full(2, 0.5), np.array([[0.9, 0.1], [0.2, 0.8]]), r.dirichlet(np.ones(5), 2))
    seqs = [r.integers(0, 5, n) for n in (3, 5000, 1, 1024, 1025)]
    first, symbols = np.r_[0, np.cumsum([len(x) for x in seqs])], np.concatenate(seqs)
    counts, found = hmm._expected(m, first, symbols)
    alone = [hmm._expected(m, np.array([0, len(x)]), x) for x in seqs]
    assert np.allclose(counts, sum(a for a, _ in alone)) and np.isclose(found, hmm.log_likelihood(m, first, symbols).sum())
    steps, made = [], hmm.Model.from_counts.__func__
    monkeypatch.setattr(hmm.Model, "from_counts", classmethod(lambda cls, c, share, states: steps.append(c) or made(cls, c, share, states)))
    long = "q r " * 60_000  # over 100,000 bytes: read in every step
    hmm.score_texts(spark, docs_of(["a b a b", long, "a b c"] * 3)).count()
    trained = sum(len((t or "").split()) + 1 for k, t in enumerate(["a b a b", long, "a b c"] * 3) if zlib.crc32(str(k).encode()) % 7 != 2)
    assert len(steps) > 1 and all(np.isclose(c[8 + 64 : -1 if len(c) % 8 else None].sum(), trained) for c in steps)


def test_oracle_queries_match_sql(spark, data):
    from millrace.llm import queries as Q
    from oracle import connect, rows

    for name, sql in Q.oracle_sql().items():
        got, want = Q.queries()[name](spark, data).toPandas(), connect(data).sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want), name


def test_digest_columns(spark, data):
    from millrace.llm import queries as Q

    r = Q.op6_decontamination(spark, data).where("n_items = 0").first()
    assert r["items_sha256"] == hashlib.sha256(b"").hexdigest() and not r["contaminated"]
