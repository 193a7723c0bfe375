"""Main text of pages, the class language model, the pipeline, and every query against its SQL."""

import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from cases import PAGES, no_docs, odd_docs, prose

sys.path[:0] = [str(Path(__file__).resolve().parent.parent.parent), str(Path(__file__).resolve().parent.parent)]

import corpus_pipeline  # noqa: E402
from compare import compare, connect  # noqa: E402

from tidemark.llm import class_lm, main_text, registry  # noqa: E402

registry.load_all()
SF = "/root/testdata/sf0.001"


def blocks(page):
    return main_text.blocks_of(page)


def test_blocks_by_mark_up():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><!-- <article>no</article> --><header>Site</header><nav><ul><li>a<li>b</ul></nav>'
        '<div class="ad big"><div>buy</div></div><article><header><h1>Head &amp; tail</h1></header><p>One<br>two&nbsp; three <b>bo</b>ld<p title="a>b">four'
        '<aside>side</aside><div id=share-box>share</div><table><tr><td>c1<td>c2</table><script>if (a<b) x="</p>";</script>&lt;p&gt; 5 < 6'
        '<section class="comments"><article>first!</article></section><footer>f</footer></article><form>q<input></form><footer>&copy;</footer>'
    )
    main, other, cued = blocks(page)
    assert main == ["Head & tail", "One two three bold", "four", "c1 c2", "<p> 5 < 6"]
    assert other == ["Site", "a", "b", "buy", "side", "share", "first!", "f", "q", "©"] and all(cued)


def test_broken_pages_do_not_fail():
    for page in ("", "<", "<p", "<!--", "<article><p>x", "</article></div>y", "<script>never closed", "<nav>open<article>in</article>", "a < b > c", '<p class="x>y', "\x00"):
        blocks(page)
    assert blocks("<nav>open<article>in</article>")[0] == ["in"]
    assert blocks("<div role='main'><div>a</div>b</div>c")[:2] == (["a", "b"], ["c"])


def test_covered_words_equal_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(30):
        pages = [draw.integers(0, 3, draw.integers(0, 30)).tolist() for _ in range(6)]
        stream, owner = [], []
        for k, page in enumerate(pages):
            stream += [*page, 100 + k]
            owner += [k] * (len(page) + 1)
        found = main_text.covered_words(np.array(stream), np.array(owner), 4, 3)
        seen = {}
        for k, page in enumerate(pages):
            for i in range(len(page) - 3):
                seen.setdefault(tuple(page[i : i + 4]), set()).add(k)
        expected = [False] * len(stream)
        at = 0
        for page in pages:
            for i in range(len(page) - 3):
                if len(seen[tuple(page[i : i + 4])]) >= 3:
                    expected[at + i : at + i + 4] = [True] * 4
            at += len(page) + 1
        assert found.tolist() == expected


def test_runs_of_a_host_equal_brute_force(monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(5)
    ranked, plain = [], main_text.suffix_ranks
    monkeypatch.setattr(main_text, "suffix_ranks", lambda codes, depth: ranked.append(depth) or plain(codes, depth))
    for width in (3, 4, 8):
        pages = [" ".join(map(str, draw.integers(0, 2, draw.integers(0, 40)))) for _ in range(9)]
        hosts = [f"h{k % 2}" for k in range(9)]
        split = [[w for w in (p[: len(p) // 2], p[len(p) // 2 :]) if w.strip()] for p in pages]
        classes, names, at, _ = main_text.page_runs(pa.array(hosts), pa.array(split, pa.list_(pa.string())), width)
        want = []
        for host, blocks in zip(hosts, split, strict=True):
            words = "\n".join(blocks).split()
            want.append([(host, *words[i : i + width]) for i in range(len(words) - width + 1)])
        flat = [run for page in want for run in page]
        assert np.diff(at).tolist() == [len(page) for page in want]
        assert len(names) == len(set(names.tolist())) == len(set(flat))
        assert len({(c, run) for c, run in zip(classes.tolist(), flat, strict=True)}) == len(set(flat))
    assert ranked == [3, 4, 8]


def test_host_boilerplate_goes_where_mark_up_says_nothing(spark):
    menu = "Home News Sport Weather Travel Money Health Culture"
    rows = [(k, f"http://h.com/{k}", f"<div>{menu}</div><p>{prose(k, 30, 10**6)}</p><p>{prose(1, 60)}</p>" if k < 2 else f"<div>{menu}</div><p>{prose(k, 30, 10**6)}</p>") for k in range(8)]
    rows += [(20, "http://other.com/", f"<div>{menu}</div><p>x</p>"), (21, None, None), (22, "http://h.com/", ""), (22, "http://h.com/", "plain &eacute;")]
    rows += [(30 + k, "http://copies.com/", f"<p>{prose(77, 40)}</p>") for k in range(3)]
    pages = spark.createDataFrame([(*r, "h", "p", "b", 1) for r in rows], PAGES)
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in main_text.main_texts(pages).collect()]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    texts = {p: t for p, t, _ in got}
    assert texts[3] == prose(3, 30, 10**6) and texts[0] == f"{prose(0, 30, 10**6)}\n{prose(1, 60)}"
    assert texts[20] == f"{menu}\nx" and texts[21] == "" and sorted(t for p, t, _ in got if p == 22) == ["", "plain é"]
    assert texts[30] == prose(77, 40)
    assert main_text.main_texts(pages.limit(0)).collect() == []


def test_boilerplate_on_three_pages_of_a_large_host_goes(spark):
    rows = [(k, f"http://big.com/{k}", f"<p>{prose(k, 12, 10**6)}</p>" + (f"<div>{prose(k // 3, 12, 10**6, 'b')}</div>" if k < 30 else "")) for k in range(4500)]
    # Two pages are too few, and another host's pages do not count.
    rows += [(9000, "http://big.com/x", f"<p>{prose(1, 12, 10**6, 'y')}</p><div>{prose(2, 12, 10**6, 'y')}</div>"), (9001, "http://big.com/y", f"<div>{prose(2, 12, 10**6, 'y')}</div>")]
    rows += [(9002, "http://small.com/", f"<div>{prose(2, 12, 10**6, 'y')}</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    texts = {r["page_id"]: r["text"] for r in main_text.main_texts(pages).collect()}
    assert len(texts) == len(rows) and all(texts[k] == prose(k, 12, 10**6) for k in range(4500))
    assert texts[9000] == f"{prose(1, 12, 10**6, 'y')}\n{prose(2, 12, 10**6, 'y')}"


def test_lines_of_a_template_go_from_main_texts(spark):
    line, licence = "Read more of our stories by signing up for the letter", prose(5, 12, 10**6, "l")
    rows = [(k, "http://h.com/", f"<article><p>{prose(k, 30, 10**6)}</p><p>{licence if k < 5 else prose(k, 9, 10**6, 'z')}</p><p>{line}</p></article><div>out</div>") for k in range(12)]
    # A page without the line, one whose every block is shared, another host's two pages, and a host of copies.
    rows += [(20, "http://h.com/", f"<main><p>{prose(20, 30, 10**6)}</p></main>"), (21, "http://h.com/", f"<main><p>{line}</p></main>")]
    rows += [(30 + k, "http://two.com/", f"<article><p>{prose(30 + k, 30, 10**6)}</p><p>{line}</p></article>") for k in range(2)]
    rows += [(40 + k, "http://copies.com/", f"<article><p>{prose(77, 40)}</p></article>") for k in range(4)] + [(50, None, "<article>short</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    texts = {r["page_id"]: r["text"] for r in main_text.main_texts(pages).collect()}
    want = {k: f"{prose(k, 30, 10**6)}\n{licence if k < 5 else prose(k, 9, 10**6, 'z')}" for k in range(12)}
    want |= {20: prose(20, 30, 10**6), 21: line, 50: "short"} | {30 + k: f"{prose(30 + k, 30, 10**6)}\n{line}" for k in range(2)} | {40 + k: prose(77, 40) for k in range(4)}
    assert texts == want


def base_scores(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    counts, ends = Counter(), 0
    for words, out in zip(tokens, held):
        if not out:
            counts.update(words)
            ends += 1
    total = sum(counts.values()) + ends
    room = total + len(counts) + (ends > 0) + 1
    return [
        (d, h, len(w) + 1, sum(counts[x] > 0 for x in w) + (ends > 0), total, round(sum(math.log10((counts[x] + 1) / room) for x in w) + math.log10((ends + 1) / room), 4))
        for (d, _), h, w in zip(rows, held, tokens)
    ]


def test_base_scores_equal_brute_force_and_odd_rows(spark):
    docs = odd_docs(spark)
    got = class_lm.score_texts(docs).collect()
    plain = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got]
    assert sorted(plain, key=str) == sorted(base_scores([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert class_lm.score_texts(no_docs(spark)).collect() == []


def test_classes_beat_unigrams_on_held_out_texts(spark):
    rows = [(k, prose(k, 200, 300, "ab"[k % 2])) for k in range(300)]
    got = class_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r["held_out"]]
    gain = (sum(r["score"] for r in held) - sum(r["base_score"] for r in held)) / sum(r["n_tokens"] for r in held)
    # The two halves share no word, so knowing the half is worth one bit a word.
    assert gain > 0.25


def class_scores(rows, min_count, min_share):
    """The class model in plain Python, with classes dealt in turn to frequent words and not exchanged."""
    classes, endings = class_lm.CLASSES, class_lm.ENDINGS
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    train = [w for (d, _), w in zip(rows, texts) if zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(x for w in train for x in w)
    tokens = sum(count.values()) + len(train)
    least = max(min_count, math.ceil(min_share * tokens))
    ending = lambda x: zlib.crc32(x[-3:].encode()) % endings
    by_rank = sorted((x for x in count if count[x] >= least), key=lambda x: (count[x], int(class_lm.hashes([x]).view(np.int64)[0])), reverse=True)
    cls = {x: k % classes for k, x in enumerate(by_rank)}
    further = [x for x in count if min_count <= count[x] < least]
    # Contexts while further words still count by their endings; None is the end.
    context = lambda x: ("end",) if x is None else ("class", cls[x]) if x in by_rank else ("ending", ending(x))
    near = {x: Counter() for x in by_rank + further}
    for w in train:
        line = [None, *w, None]
        for a, b in zip(line, line[1:]):
            if a in near:
                near[a]["right", context(b)] += 1
            if b in near:
                near[b]["left", context(a)] += 1
    table = [Counter() for _ in range(classes)]
    for x in by_rank:
        table[cls[x]].update(near[x])
    h = lambda n: n * math.log(n) if n else 0.0
    for x in further:
        size = sum(near[x].values())
        gains = [sum(h(t[c] + n) - h(t[c]) for c, n in near[x].items()) - h(t.total() + size) + h(t.total()) for t in table]
        cls[x] = next(k for k, g in enumerate(gains) if g >= max(gains) - 1e-9)
    # Targets: a class, or an ending with 0 (unknown), 1 (met once) or 2 (more).
    target = lambda x, less: ("end",) if x is None else ("class", cls[x]) if x in cls else (ending(x), min(2, max(0, count[x] - less)))
    steps = Counter()
    for w in train:
        line = [None, *w, None]
        steps.update((target(a, 1), target(b, 1)) for a, b in zip(line, line[1:]))
    states = classes + 3 * endings + 1
    after, before = Counter(), Counter()
    for (a, b), n in steps.items():
        before[a] += n
        after[b] += n
    chance = lambda a, b: (steps[a, b] + class_lm.PULL * (after[b] + 0.01) / (steps.total() + 0.01 * states)) / (before[a] + class_lm.PULL)
    out = {}
    for (d, _), w in zip(rows, texts):
        line, score = [None, *w, None], 0.0
        for a, b in zip(line, line[1:]):
            a, t = target(a, 0), target(b, 0)
            if t[-1] == 0 and t[0] != "class":
                score += math.log10(sum(chance(a, (e, 0)) for e in range(endings)))
                continue
            mass = 1
            if t[0] == "class":
                mass = max(1, sum(count[x] for x in cls if cls[x] == t[1])) / count[b]
            elif t[0] != "end":
                alike = [count[x] for x in count if x not in cls and ending(x) == t[0] and (count[x] > 1) == (t[1] == 2)]
                mass = sum(alike) / count[b]
            score += math.log10(chance(a, t) / mass)
        out[d] = round(score, 4)
    return out


def test_class_scores_equal_brute_force(spark):
    rows = [(k, f"{prose(k, 60, 40, 'ab'[k % 2])} {prose(k, 40, 700)}" if k else None) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: round(r["score"], 4) for r in class_lm.score_texts(docs, rounds=0, min_share=0.005, min_count=3).collect()}
    assert got == pytest.approx(class_scores(rows, 3, 0.005), abs=2e-4)


def test_clustered_words_grow_with_the_corpus(spark):
    # Twice the texts, twice the words met often enough; those of a large share do not become more.
    rows = [(k, prose(k, 100, 100, "ab"[k // 300])) for k in range(600)]
    clustered = []
    for n in (300, 600):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        seen = []
        kept = class_lm.join_classes
        class_lm.join_classes = lambda *a, seen=seen: seen.append(kept(*a)) or seen[0]
        try:
            assert class_lm.score_texts(docs, rounds=1, min_share=0.02, min_count=20).count() == n
        finally:
            class_lm.join_classes = kept
        clustered.append(seen[0].count())
    assert 1.8 * clustered[0] < clustered[1] and clustered[0] > 50


def test_transitions_add_up_to_one():
    units = class_lm.Units(5)
    counts = np.random.default_rng(0).integers(0, 9, (units.classes, units.classes)).astype(float)
    chance = 10 ** class_lm.log_transitions(counts, units)
    unknown = class_lm.CLASSES + 3 * np.arange(class_lm.ENDINGS)
    known = np.setdiff1d(np.arange(units.classes), unknown)
    assert np.allclose(chance[:, known].sum(axis=1) + chance[:, unknown[0]], 1)


def test_exchange_never_lowers_the_likelihood():
    draw = np.random.default_rng(1)
    words = {w: (np.arange(8), draw.integers(0, 20, 8).astype(float)) for w in range(40)}
    assigned = np.arange(40) % class_lm.CLASSES

    def likelihood(now):
        table = np.zeros((class_lm.CLASSES, 8))
        for w, (cells, counts) in words.items():
            table[now[w], cells] += counts
        return class_lm.entropy(table).sum() - class_lm.entropy(table.sum(axis=1)).sum()

    table = np.zeros((class_lm.CLASSES, 8))
    for w, (cells, counts) in words.items():
        table[assigned[w], cells] += counts
    moved = class_lm.exchange(table, assigned, words)
    assert likelihood([moved[w] for w in range(40)]) >= likelihood(assigned) - 1e-6


def test_pipeline_stages(spark, tmp_path):
    item = prose(500, 40, 10**6)
    docs = odd_docs(spark).union(odd_docs(spark).limit(1).selectExpr("50L", f"'{prose(9, 80)} {item}'", *odd_docs(spark).columns[2:]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    found, now = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns, name
        found.append(sorted(str(r["doc_id"]) for r in now.collect()))
    assert not {"4", "5", "6", "12"} & set(found[0]) and len(found[0]) == 11
    assert found[1] == sorted(["1", "2", "2", "3", "9", "None", "50"])
    assert found[2] == sorted(["1", "9", "None", "50"]) and found[3] == sorted(["1", "9", "None"])
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {str(p["doc_id"]) for p in pieces} == {"1", "9", "None"}
    assert sum(p["length"] for p in pieces) == sum({str(p["doc_id"]): p["doc_tokens"] for p in pieces}.values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    no_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        assert compare(df, connect(SF), registry.ORACLES[name]) == []
    else:
        assert df.count() > 0
