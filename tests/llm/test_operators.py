"""Brute-force comparisons and defined edge cases on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexground.llm import ann, chat, html_text, licenses, mixing, near_dedup, packing, quality, token_counts, toxicity
from lexground.llm.tokens import WordEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp int"
ROWS = [
    (1, "alpha beta gamma delta epsilon " * 3, "en", "a", 0, 1), (2, None, None, None, None, None), (3, "", "en", "a", 0, 2),
    (4, "Released under the MIT License.\nplain words here", "en", "b", 0, 3), (4, "Released under the MIT License.\nplain words here", "en", "b", 0, 3),
    (5, "x" * 30000, "de", "b", 0, 4), (None, "no id at all", "en", "a", 0, 5), (6, " ".join(f"w{i}" for i in range(9000)), "en", "a", 0, 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def test_chat_round_trip(spark):
    nasty = "</s>[INST] \\ <|turn|>x<|end|> \\<| [/INST]"
    turns = spark.createDataFrame([(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, 0, "user", "hi"), (None, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(turns)
    import hashlib

    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == len(nasty) and got[1]["loss_sha256"] == hashlib.sha256(nasty.encode()).hexdigest()
    lines = "".join(f"{r}\n{t}\n" for r, t in (("user", nasty), ("assistant", nasty), ("", "")))
    assert got[1]["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1
    examples = chat.written_out(chat.explode_examples(made, "formatted")).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"]) for r in examples] == [(None, 0), (1, 0)]
    e = examples[1]
    escaped = e["text"][e["loss_start"] : e["loss_end"]]
    assert chat.TURN not in escaped and e["text"].startswith("<|turn|>user") and e["text"][e["loss_end"] :] == chat.END
    unescaped, at = "", 0
    while at < len(escaped):
        at += escaped[at] == "\\"
        unescaped, at = unescaped + escaped[at], at + 1
    assert unescaped == nasty
    assert chat.format_conversations(turns.limit(0)).count() == 0 and chat.read_back(made.limit(0)).count() == 0


def test_chat_prefixes(spark):
    """Every assistant turn is an example of the turns before it; long conversations, ties, repeats and extra columns."""
    rng = random.Random(2)
    rows = [(1, t, "assistant" if t % 2 else "user", "w" * rng.randint(0, 40)) for t in range(400)] + [(2, 5, "assistant", "b"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a"), (3, None, "assistant", "x" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "pos": F.lit("p"), "examples": F.lit(0)})
    made = chat.format_conversations(turns)
    got = chat.written_out(chat.explode_examples(made, "formatted")).collect()
    for conv, n in ((1, 200), (2, 3), (3, 1)):
        own = sorted((r[1], r[3]) for r in rows if r[0] == conv) if conv == 2 else [(r[1], r[3]) for r in rows if r[0] == conv]
        parts = [f"{chat.TURN}{'assistant' if conv != 1 or t % 2 else 'user'}{chat.BODY}{x}{chat.END}" for t, x in own]
        trained = [i for i, (t, _) in enumerate(own) if conv != 1 or t % 2]
        found = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["example"])
        assert len(found) == n == len(trained)
        for r, i in zip(found, trained, strict=True):
            assert r["text"] == "".join(parts[: i + 1]) and r["text"][r["loss_start"] : r["loss_end"]] == own[i][1]


def test_chat_losses_go_through_prefixes(spark):
    """An example is a prefix and a target, and the losses that are read back are those of the expanded examples."""
    rows = [(1, 0, "user", "hé <| \\"), (1, 1, "assistant", "böb [INST]"), (1, 2, "user", "more"), (1, 3, "assistant", ""), (1, 4, "assistant", "😀 end"), (2, 0, "user", "hi")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    formatted = {r["conv_id"]: r["formatted"] for r in made.collect()}
    found = chat.explode_examples(made).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"]) for r in found] == [(1, 0), (1, 1), (1, 2)]
    for r, escaped in zip(found, ["böb [\\INST]", "", "😀 end"], strict=True):
        assert r["prefix"].endswith("<|turn|>assistant<|body|>") and r["target"] == escaped + chat.END and r["loss_chars"] == len(escaped)
        assert formatted[1].startswith(r["prefix"] + r["target"])
    losses = lambda df: {r["conv_id"]: (r["n_examples"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(df).collect()}
    whole, shifted = losses(made), losses(made.withColumn("formatted", F.expr("substring(formatted, 2)")))
    assert whole[1][:2] == (3, 15) and whole[2][:2] == (0, 0) and shifted[1] != whole[1] and shifted[2] == whole[2]


def test_encoder_equals_tokenizer():
    e, rng = WordEncoder(), random.Random(3)
    pool = "abcTHE'sdmlv  \n.,!?%&*|#0189éèüßñçØž_-/()[]{}<>|日😀²½ªº́\xa0\t"
    texts = ["<|endoftext|> a", "It's I'LL", *("".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(500))]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def check_packing(rows, capacity=4096):
    assert rows.groupby("sequence_id").length.sum().max() <= capacity
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def test_packing(spark, docs):
    from zlib import crc32

    rows = packing.pack(docs.withColumns({"bin": F.lit(1), "fill": F.lit("f"), "grp": F.lit(2)})).toPandas()
    check_packing(rows)
    assert len(rows[rows.doc_id == 3]) == 1 and rows[rows.doc_id == 2].length.tolist() == [1]
    assert packing.pack(docs.limit(0)).count() == 0
    tokenizer, want = WordEncoder().tokenizer, []
    for doc_id, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((doc_id, k, at, len(part), crc32(np.array(part, "<u4").tobytes())))
    got = [(None if np.isnan(d) else int(d), *r) for d, *r in rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_packing_over_groups(spark):
    """Several groups that exchange: gapless, nothing lost, few sequences over the bound, and no task above a group's mass."""
    rng = random.Random(4)
    rows = [(i, "a " * (rng.choice((3, 20, 45, 55, 70)) - 1)) for i in range(3000)] + [(-1, "a " * 60)] * 500
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(d, capacity=100, group_bins=60).toPandas()
    check_packing(got, 100)
    assert len(got) == len(rows) and got["round"].max() >= 2
    n, bound, whole = got.sequence_id.nunique(), packing.lower_bound(got.length.to_numpy(), 100), len(packing.best_fit_decreasing(got.length.to_numpy(), 100)[2])
    assert bound <= n <= 1.02 * whole
    # documents of just over half a sequence: certified at once, so no bin moves
    d = spark.createDataFrame([(i, "a " * 51) for i in range(600)], "doc_id long, text string")
    got = packing.pack(d, capacity=100, group_bins=12).toPandas()
    check_packing(got, 100)
    assert got.sequence_id.nunique() == 600 and got["round"].max() == 0 and (got.n_bins <= 40).all()


def test_bounds_and_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 40))
        bins, offsets, fill = packing.best_fit_decreasing(lengths, 100)
        assert fill.max() <= 100 and fill.sum() == lengths.sum() and packing.lower_bound(lengths, 100) <= len(fill)
    assert packing.lower_bound([60, 60, 60, 40], 100) == 3

    def fewest(lengths, free, n):  # all packings
        if not lengths:
            return n
        best = fewest(lengths[1:], [*free, 100 - lengths[0]], n + 1)
        for i, f in enumerate(free):
            if f >= lengths[0] and f not in free[:i]:
                best = min(best, fewest(lengths[1:], [*free[:i], f - lengths[0], *free[i + 1 :]], n))
        return best

    for _ in range(60):
        lengths = sorted(rng.integers(15, 80, 8).tolist(), reverse=True)
        least = fewest(lengths, [], 0)
        assert packing.lower_bound(lengths, 100) <= least <= len(packing.best_fit_decreasing(lengths, 100)[2]) <= least + 1
    assert packing.staying(np.array([100, 95, 30]), 2.3, 100).tolist() == [True, True, False]
    assert packing.staying(np.array([51, 51]), 2.0, 100).all()


def test_near_dedup(spark, docs):
    rng = random.Random(5)
    base = [[f"v{rng.randint(0, 5000)}" for _ in range(200)] for _ in range(12)]
    rows = []
    for i, words in enumerate(base):
        for k in range(6):
            w = list(words)
            for _ in range(k // 3):
                w[rng.randrange(200)] = "edit"
            rows.append((i * 10 + k, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: set(zip(*[t.split()[j:] for j in range(5)])) for d, t in rows}
    for a in sets:
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert got[a] == got[b]
            elif a // 10 != b // 10:
                assert got[a] != got[b]
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (2, 3)").count() == 1 and kept.filter("doc_id = 4").count() == 1
    assert near_dedup.classes(docs.limit(0)).count() == 0


def test_near_dedup_goes_by_rows(spark):
    """Null and repeated doc_ids, clashing names, and copies of them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (None, a), (None, c), (None, c.upper()), (5, b + "."), (7, ""), (8, None), (9, "..."), (2, b)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "row_key": F.lit("k"), "n": F.lit(2), "document": F.lit("d"), "first": F.lit("f")})
    got = sorted(str((r["doc_id"], r["class_id"])) for r in near_dedup.classes(d).collect())
    assert got == sorted(map(str, [(1, 1), (1, 1), (None, 1), (None, None), (None, None), (5, 1), (7, 7), (8, 7), (9, 7), (2, 1)]))
    kept = near_dedup.keep_one(d)
    assert kept.columns == d.columns
    words = sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in kept.collect())
    assert words == sorted([("1", a), ("1", b), ("7", ""), ("None", c)])


def test_near_dedup_loses_no_link(spark):
    """A crowd of copies around one text, many under the similarity to its middle: the classes are those of brute force."""
    rng = random.Random(8)
    base, rows = [f"u{i}" for i in range(150)], []
    for d in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = f"e{rng.randint(0, 3)}"
        rows.append((d, " ".join(w)))
    from collections import Counter

    def shingles(t):
        w = t.split()
        return Counter(zip(*[w[j:] for j in range(5)]))

    sets, group = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    for a in sets:
        for b in range(a):
            if (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total() and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group and len(set(group.values())) > 5


def text_of(page, hashes=None, neighbours=()):
    lines = html_text.blocks(page)
    return html_text.main_text([x for x, _ in lines], [v for _, v in lines], hashes or [hash(x) for x, _ in lines], list(neighbours))


def test_html():
    page = '<html><nav><a>m</a></nav><header>h</header><article><h1>T &amp; U</h1><p>one<br>two <b>x</b>y<p>three<div class="comments">c</div><script>"<p>z"</script></article><footer>f</footer>'
    assert text_of(page) == "T & U\none two xy\nthree"
    assert html_text.main_text(["a", "b", "c" * 9], [0, 0, 0], [1, 2, 3], [[1, 7], [8, 2]]) == "c" * 9
    assert html_text.main_text(["a", "b", "c" * 9], [-1, 2, 2], [1, 2, 3], [[1, 2]]) == "b\n" + "c" * 9
    assert html_text.blocks("") == []
    assert text_of('<article><p>a<p class="related-work">b</p><ul class="menu-items"><li>c</ul><div class="ad-box">d</div><div class="share">e</div></article>') == "a\nb\nc"
    assert text_of("<main><p>the real body</p><article class=card>teaser</article></main>") == "the real body"
    assert text_of('<div class="menu-items">m</div><p>x<span class="ad">y</span> z') == "x z"


def test_common_lines():
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng, held = random.Random(1), html_text.HELD_BITS
    for n in range(400):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 25))] for _ in range(2))
        html_text.HELD_BITS = 20 if n % 2 else held
        got = [a[i] for i in sorted(html_text.common_lines(a, b))]
        rest = iter(b)
        assert len(got) == longest(a, b) and all(x in rest for x in got)
    html_text.HELD_BITS = held


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "http://h/a/1", "<p>x</p>"), (2, "http://h/a/1", "<p>x</p>")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_text.extract(pages.withColumns({"host": F.lit(1), "part": F.lit("p"), "text": F.lit("t")})).collect()) == ["", "x", "x"]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_differencing(spark):
    """Pages without any mark: what the nearest pages of the host share goes, in folders of one page, over ranges, whatever their size."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        host, folder = ("big", f"d{rng.randint(0, 40):02d}/p{i:03d}") if i < 250 else (f"h{i % 10}", f"lonely{i}/x")
        body = [f"body {i} {k} {rng.random()}" for k in range(rng.randint(1, 5))]
        top, end = [f"menu of {host}", f"head of {host}"], [f"foot of {host}"]
        rows.append((i, f"http://{host}/{folder}", "".join(f"<div>{x}</div>" for x in [*top, *body, *end]), "\n".join(body), [*top, *body, *end]))
    rows.append((900, None, "<p>" + "long words " * 200_000 + "</p>", ("long words " * 200_000).strip(), ["x"]))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    want = {r[0]: r[3] for r in rows}
    for width in (2, 20, 10**6):
        got = {r["page_id"]: r["text"] for r in html_text.extract(pages, width).collect()}
        assert got == want


def test_mixing(spark, docs):
    rows = mixing.replicate(docs)
    assert set(docs.columns) <= set(rows.columns) and rows.filter("mix_copy >= mix_copies").count() == 0
    assert mixing.replicate(docs.limit(0)).count() == 0
    clashing = docs.withColumns({c: F.lit(f"own {c}") for c in ("mix_rate", "rate_source", "mix_copies", "mix_key", "document", "size", "a.b")})
    kept = mixing.replicate(clashing)
    assert kept.columns == [*clashing.columns, "mix_copy"] and kept.count() == rows.count()
    assert all(r[c] == f"own {c}" for r in kept.collect() for c in ("mix_rate", "rate_source", "mix_copies", "a.b"))
    rate, n = 2.5, 4000
    drawn = spark.range(n).select(mixing.poisson_quantile(F.lit(rate), mixing.hashed_uniform(F.lit("t"), F.col("id").cast("string"))).alias("k")).toPandas().k
    assert abs(drawn.mean() - rate) < 0.1 and abs(drawn.var() - rate) < 0.25


def test_token_counts(spark, docs):
    lengths = token_counts.encoded_lengths(docs)
    n = [r["n_tokens"] for r in lengths.collect()]
    for r in token_counts.suffix_sums(token_counts.histogram(lengths), block=3).collect():
        limit = r["n_tokens"]
        assert r["kept_tokens"] == sum(min(x, limit) for x in n) and r["docs_over"] == sum(x > limit for x in n) and r["total_tokens"] == sum(n)
    tokenizer = WordEncoder().tokenizer
    assert sorted(n) == sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    limits = [0, 1, 2, 7, 5000, 10**6]
    hist = token_counts.histogram(lengths)
    for r in token_counts.for_limits(hist, spark.createDataFrame([(x,) for x in limits], "n_tokens int")).collect():
        assert r["kept_tokens"] == sum(min(x, r["limit"]) for x in n) and r["docs_over"] == sum(x > r["limit"] for x in n) and r["tokens_over"] == sum(x for x in n if x > r["limit"])
        limits.remove(r["limit"])
    assert not limits
    for r in token_counts.quantiles(hist, [0.0, 0.3, 0.5, 1.0]).collect():
        assert r["n_tokens"] == min(x for x in n if sum(y <= x for y in n) >= r["share"] * len(n))
    empty = token_counts.histogram(token_counts.encoded_lengths(docs.limit(0)))
    assert token_counts.suffix_sums(empty).count() == 0 and token_counts.quantiles(empty, [0.5]).count() == 0


def test_repeated_words():
    rng = random.Random(2)
    for _ in range(300):
        words = [str(rng.randint(0, 3)) for _ in range(rng.randint(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        want = len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)})
        assert quality.repeated_words(words) == want


def test_quality_measures(spark):
    """Every measure against its definition, and each row by its own text."""
    import re

    import sentencepiece
    from lexground.llm.tokens import PIECE_VOCABULARY, vocabulary

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_VOCABULARY))
    rng = random.Random(7)
    texts = [None, "", " \n\t ", "a b\n a b\na b\n\n", "#*$%&|<>", "w " * 5000]
    texts += ["".join(rng.choices(["ab", "c", "#", " ", "  ", "\n", "\r\n", "\x0b", "é", "日", "😀", "the ", "|", "\u00a0"], k=rng.randint(0, 200))) for _ in range(150)]
    texts += [" ".join(rng.choices(["red", "blue", "one"], k=rng.randint(5, 60))) for _ in range(50)]
    d = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "kept": F.lit("k"), "band": F.lit(1), "m": F.lit(2), "n": F.col("text")})
    got = {}
    for r in quality.judge(d).collect():
        got.setdefault((r["doc_id"], r["n"]), r)
    for i, t in enumerate(texts):
        r, text = got[i // 2, t], t or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        counts = {w: windows.count(w) for w in set(windows)} if len(words) < 1000 else {w: 2 for w in windows}
        repeated = len({j for k, w in enumerate(windows) if counts[w] > 1 for j in range(k, k + 5)})
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated), text
        assert r["base_failed"] == (len(words) < 10 or 100 * repeated > 20 * len(words))
        ids = [j for w in words for j in model.encode(w)]
        assert r["n_tokens"] == len(ids) and abs(r["chars_per_token"] - sum(map(len, words)) / max(1, len(ids))) < 1e-9
        if len(ids) > 1:
            p = np.unique(ids, return_counts=True)[1] / len(ids)
            assert abs(r["entropy"] + (p * np.log(p)).sum() / np.log(len(ids))) < 1e-9
            assert abs(r["byte_share"] - np.mean([model.is_byte(j) for j in ids])) < 1e-9
    kept = quality.keep(d)
    assert kept.columns == d.columns and quality.keep(d.limit(0)).count() == 0
    wanted = sorted(r["n"] for r in quality.judge(d).filter("kept").collect())
    assert sorted(r["text"] for r in kept.collect()) == wanted and wanted and kept.filter("kept <> 'k' or band <> 1").count() == 0


def test_quality_verdict(spark):
    """The verdict against its definition in plain Python, with exact quartiles and their leaning on wider groups."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(400)]
    rows = [(i, rng.choice(("x", "y", None)), " ".join(rng.choices(words, k=rng.choice((12, 30, 80, 300))) if rng.random() < 0.95 else [chr(rng.randint(0x1F300, 0x1F400)) + chr(rng.randint(0x1F300, 0x1F400)) for _ in range(30)])) for i in range(400)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).toPandas()
    got["lang"] = [r[1] or "" for r in (rows[i] for i in got.doc_id)]
    got["cls"] = np.floor(2 * np.log2(np.maximum(got.n_tokens, 1))).astype(int)
    passing = got[~got.base_failed]
    for r in got.itertuples():
        sides, middle = {}, {}
        for m in quality.METRICS:
            sides[m], middle[m] = [quality.UNSURE[m]] * 2, None
            for w in reversed(quality.WIDTHS):
                group = passing[(passing.lang == r.lang) & (passing.cls // w == r.cls // w)][m].round(4)
                if len(group):
                    q, n = np.quantile(group, [0.25, 0.5, 0.75]), len(group)
                    middle[m] = q[1] if middle[m] is None else (n * q[1] + 20 * middle[m]) / (n + 20)
                    sides[m] = [(n * own + 20 * s) / (n + 20) for own, s in zip((q[1] - q[0], q[2] - q[1]), sides[m], strict=True)]
        if r.base_failed:
            assert not r.kept
            continue
        off = lambda m, i: (getattr(r, m) - middle[m]) / max(sides[m][i], quality.LEAST[m])  # noqa: B023, E731
        below = off("chars_per_token", 0) + off("entropy", 0)
        assert abs(below - r.below) < 1e-6
        over = off("byte_share", 1) > quality.REACH and r.byte_share - middle["byte_share"] > quality.LEAST_BYTES
        assert r.kept == (not (below < -quality.REACH or over or r.entropy * np.log(r.n_tokens) < quality.LEAST_NATS))
    assert 0 < got.kept.sum() < (~got.base_failed).sum()


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert got[2]["n_words"] == 0 and not got[2]["kept"] and got[6]["kept"] and got[1]["base_failed"]
    assert quality.judge(docs.limit(0)).count() == 0


def test_quality_of_rare_languages(spark):
    """Texts are judged by their own language, in neighbouring lengths if need be, and by a fixed band where it is too rare."""
    rng = random.Random(9)

    def text(words, n):
        return " ".join(rng.choices(words, k=n))

    english = [f"{a}{b}" for a in ("water", "house", "river", "table", "stone", "light") for b in ("s", "ed", "ing", "er", "less", "like")]
    chinese = ["".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range(3)) for _ in range(300)]
    georgian = ["".join(chr(rng.randint(0x10D0, 0x10F0)) for _ in range(6)) for _ in range(300)]
    rows = [("en", text(english, rng.choice((60, 120, 240, 480, 960)))) for _ in range(600)]
    rows += [("zh", text(chinese, 30 if i < 30 else 45)) for i in range(60)] + [("ka", text(georgian, 40)) for _ in range(20)]
    rows += [("ka", " ".join("\u10d0" * k for k in range(1, 40)))]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    got = quality.judge(d).filter("not base_failed").toPandas()
    kept = got.groupby("lang").kept
    assert kept.count()["zh"] == 60 and kept.mean()["zh"] > 0.9 and got[got.lang == "zh"].below.notna().all()
    ka = got[got.lang == "ka"].sort_values("doc_id")
    assert ka.kept.tolist() == [True] * 20 + [False] and len(got.columns) == len(quality.judge(d.limit(0)).columns)


def test_toxicity(spark, docs):
    rng = random.Random(4)
    words = [f"plain{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=30) + (["vilest"] if i % 3 == 0 else []))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, labels).filter("held_out").toPandas()
    assert ((got.doc_id % 3 == 0).astype(int) == got.predicted).mean() > 0.97
    assert toxicity.score(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0


def test_toxicity_against_naive_kneser_ney(spark):
    """Word scores from the definition: class counts first, then the spelling, then continuation counts of both classes."""
    from collections import Counter
    from math import log
    from zlib import crc32

    rng, order = random.Random(5), toxicity.ORDER
    pool = ["".join(rng.choices("abcd", k=rng.randint(1, 7))) for _ in range(60)]
    texts = {i: " ".join(rng.choices(pool, k=rng.randint(1, 25))) for i in range(80)}
    toxic = {i: int(rng.random() < 0.4) for i in texts}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model, _ = toxicity.train(d, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    words = {k: Counter(w for i, t in texts.items() if toxic[i] == k and crc32(str(i).encode()) % 5 in (1, 2, 3) for w in t.split()) for k in (0, 1)}
    grams = {k: Counter() for k in (0, 1)}
    for k, counts in words.items():
        for w, n in counts.items():
            for g in toxicity.spelt(w):
                grams[k][g] += n
    levels = {order - 1: Counter(g[1:] for g in set(grams[0] + grams[1]))}
    for m in range(order - 2, -1, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])

    def discount(counts):
        n1, n2 = (sum(c == n for c in counts.values()) for n in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def lower(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        counts = levels[len(g)]
        after = {h: c for h, c in counts.items() if h[:-1] == g[:-1]}
        return (max(counts[g] - discount(counts), 0) + discount(counts) * len(after) * lower(g[1:])) / sum(after.values())

    def spelling(w, k):
        p = 1.0
        for g in toxicity.spelt(w):
            below = lower(g[1:]) if g[1:] in levels[order - 1] else toxicity.UNMET
            after = {h: c for h, c in grams[k].items() if h[:-1] == g[:-1]}
            n = sum(after.values())
            p *= below if not n else max(grams[k][g] - discount(grams[k]), 0) / n + discount(grams[k]) * len(after) / n * below
        return p

    def likelihood(w, k):
        n, spread = sum(words[k].values()), discount(words[k])
        return log(max(words[k][w] - spread, 0) / n + spread * len(words[k]) / n * spelling(w, k))

    asked = [*pool, "abba", "dddd", "xyz", "ab1"]
    got = model.words(list(dict.fromkeys(asked)))
    for w in asked:
        assert abs(got[w] - (likelihood(w, 1) - likelihood(w, 0))) < 1e-4, w


def test_toxicity_goes_by_rows(spark):
    """Repeated and null doc_ids, clashing names: each row by its own text, and the rows kept come back as they were."""
    rng = random.Random(4)
    plain = [f"plain{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(plain, k=27 if i % 3 == 0 else 30) + (["vilest"] * 3 if i % 3 == 0 else []))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    good, bad = " ".join(plain[:30]), "vilest vilest vilest " + " ".join(plain[:27])
    rows += [(1000, good), (1000, bad), (None, bad), (None, good), (1001, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "f": F.lit(1), "predicted": F.lit(7), "toxic": F.lit("t")})
    kept = toxicity.keep(d, labels)
    got = sorted((str(r["doc_id"]), r["text"], r["score"], r["f"], r["predicted"]) for r in kept.filter("doc_id is null or doc_id >= 1000").collect())
    assert kept.columns == d.columns and got == sorted([("1000", good, "s", 1, 7), ("None", good, "s", 1, 7), ("1001", None, "s", 1, 7)], key=str)
    scored = toxicity.score(d, labels)
    assert scored.columns == ["doc_id", "text", "f", "toxic", *toxicity.ADDED] and not scored.filter("doc_id is null and held_out").count()
    assert toxicity.keep(d.limit(0), labels).count() == 0


def test_toxicity_counts_every_word(spark):
    """Over 100,000 words and 300,000 character sequences, nearly all seen once: each counts, and has a score of its own."""
    from collections import Counter
    from zlib import crc32

    rng = random.Random(6)
    texts = {i: [f"{rng.getrandbits(44):011x}" for _ in range(700)] + [f"zz{i}"] for i in range(300)}
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in texts], "doc_id long, quality int, toxic int")
    model, _ = toxicity.train(d, labels)
    learnt = [i for i in texts if crc32(str(i).encode()) % 5 in (1, 2, 3)]
    words = Counter(w for i in learnt for w in texts[i])
    assert len(words) > 100_000 and sorted(model.keys.tolist()) == sorted(map(toxicity.word_key, words))
    grams = {g for w in words for g in toxicity.spelt(w)}
    assert model.letters.grams.keys.tolist() == sorted(map(toxicity.word_key, grams)) and len(grams) > 300_000
    last = {k: max(f"zz{i}" for i in learnt if (i % 3 == 0) == k) for k in (True, False)}
    found = model.words(list(last.values()))
    assert found[last[True]] > 0 > found[last[False]]


def test_licenses(spark, docs):
    got = {r["doc_id"]: r for r in licenses.scan_documents(docs).collect()}
    assert got[4]["license"] == "mit" and got[4]["n_licences"] == 1 and got[2]["n_paragraphs"] == 0 and got[6]["license"] == "none"
    names, weights, constants, temperature = licenses.model()
    lines = ["Licensed under CC BY-NC 4.0.", "An Apache helicopter landed.", "This work is licensed under the GNU General Public License, version 3.", "the licence to drive"]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "line_key string, line string")
    for r in licenses.score_lines(frame).collect():
        z = np.array(constants) + sum((np.array(weights[g]) for g in licenses.features_of(lines[int(r["line_key"])]) if g in weights), np.zeros(len(names)))
        p = np.exp(z / temperature) / np.exp(z / temperature).sum()
        assert abs(p.max() - r["probability"]) < 1e-3
        assert r["family"] == (names[int(p.argmax())] if p.max() >= licenses.SURE else licenses.UNKNOWN)


def test_wrapped_licenses(spark):
    mit = licenses.TEMPLATES["mit"][-1] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    bsd, apache = licenses.TEMPLATES["bsd"][-1], licenses.TEMPLATES["apache"][-1] + " http://www.apache.org/licenses/LICENSE-2.0"
    import textwrap

    wrap = lambda t, mark="": "\n".join(mark + x for x in textwrap.wrap(t, 60))
    texts = [
        wrap(mit), wrap(bsd), wrap(apache), f"plain words\nand more\n\n{wrap(mit)}\n \t\nthe end", wrap(apache, " * "), "MIT License", "BSD 3-Clause License\n\nplain words", "GNU Lesser General Public License",
        f"MIT License\n\n{wrap(mit)}", "a line\nReleased under the MIT License.\nb line", "Permission is hereby granted to leave.", "He met the licence\ninspector at noon.", "\n" * 20_000 + "x",
    ]
    got = [(r["license"], r["n_licences"]) for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [("mit", 1), ("bsd", 1), ("apache", 1), ("mit", 1), ("apache", 1), ("mit", 1), ("bsd", 1), ("lgpl", 1), ("mit", 2), ("mit", 1), ("none", 0), ("none", 0), ("none", 0)]


def nearest_and_share(spark, v, rows, every):
    """Recall at 5 against brute force, and the share of vectors whose cosine was computed."""
    use = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = ann.nearest(use, use.filter(f"vec_id % {every} = 0")).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5]) & set(g.vec_id))
        assert np.allclose(s[g.vec_id], g.score) and g.sort_values("rank").score.is_monotonic_decreasing
    n = got.query_id.nunique()
    return n, hits / (5 * n), got.groupby("query_id").n_verified.first().mean() / len(v)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((4000, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9050, [0.0] * 64), (9100, [float("nan")] * 64)]
    n, recall, share = nearest_and_share(spark, v, rows, 50)
    assert n == 80 and recall >= 0.9 and share < 0.6
    use = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert ann.nearest(use.limit(0), use.limit(0)).count() == 0


def test_nearest_of_clusters(spark):
    """Where vectors have clusters, few are looked at."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    v = centres[rng.integers(0, 40, 8000)] + 0.25 * rng.standard_normal((8000, 64))
    n, recall, share = nearest_and_share(spark, v, [(i, x.tolist()) for i, x in enumerate(v)], 100)
    assert n == 80 and recall >= 0.9 and share < 0.1


def test_nearest_ties(spark):
    """Equal scores rank by vec_id, rows that repeat count each, fewer than k candidates are all given, and other dimensions are none."""
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    use = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(1), "score": F.lit("s")}))
    got = [tuple(r)[:4] for r in ann.nearest(use, use.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 3, 1.0), (0, 4, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 0, 0.0), (50, 3, 1, 0.0), (50, 4, 1, 0.0), (50, 5, 3, 0.0)]


def test_workers_drop_vocabularies(spark):
    """Workers outlive stages: once the next one has run, none of them holds a vocabulary of the stage before."""
    texts = spark.createDataFrame([(i, f"some words {i}", i % 2) for i in range(600)], "doc_id long, text string, toxic int").repartition(6)

    def probe(batches):
        import gc

        for batch in batches:
            yield batch.from_pydict({"vocabularies": [sum(type(x).__name__ == "WordEncoder" for x in gc.get_objects())]})

    held = lambda: [r[0] for r in spark.range(0, 6, 1, 6).mapInArrow(probe, "vocabularies long").collect()]
    assert token_counts.encoded_lengths(texts).count() == 600 and max(held()) == 1
    assert toxicity.gram_counts(texts).filter(F.col("gram") == toxicity.WHOLE + "some").first()[1:] == (300, 300)
    assert max(held()) == 0
