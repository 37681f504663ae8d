"""Pure helpers against brute force: no Spark."""

import html as entities
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import ann, bloom, bpe, html, mixing, near_dedup, substring_dedup, text, toxicity, warc


def test_twin_bloom_has_every_repeat():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    parts = [np.r_[h[i : i + 10_000], h[:50]] for i in range(0, 50_000, 10_000)]
    met = {}
    with np.errstate(over="ignore"):
        for p in parts:
            t = bloom.Twin(1 << 20, 4)
            t.add(p)
            met["twice"] = met.get("twice", 0) | t.twice | (met.get("once", np.uint8(0)) & t.once)
            met["once"] = met.get("once", 0) | t.once
        assert bloom.has(met["twice"], h[:50], 4).all()
        assert bloom.has(met["twice"], h[50:], 4).mean() < 0.01


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=40))
def test_occurrence_labels_are_distinct(xs):
    with np.errstate(over="ignore"):
        s = text.occurrence_labelled(text.ngrams(text.word_hashes([x.encode() for x in xs]), 2))
    assert len(set(s.tolist())) == len(s) == max(0, len(xs) - 1)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, min_size=1, max_size=25), st.lists(st.integers(0, 30), unique=True, min_size=1, max_size=25))
def test_alignment_is_lcs(a, b):
    n = _lcs(a, b)
    want = n / (len(a) + len(b) - n) >= 0.8
    assert near_dedup.aligned(np.array(a, np.uint64), np.array(b, np.uint64)) == want


def test_windows_survive():
    rng = random.Random(1)
    words = [f"w{i}".encode() for i in range(3000)]
    passage = rng.sample(words, 25)
    docs = [rng.choices(words, k=200) for _ in range(30)]
    for d in docs[:3]:
        d[50:75] = passage
    with np.errstate(over="ignore"):
        first = substring_dedup.Survivors(20, [])
        t = bloom.Twin(1 << 20, substring_dedup.HASHES)
        for d in docs:
            t.add(first([d])[0])
        second = substring_dedup.Survivors(20, [t.twice])
        u = bloom.Twin(1 << 20, substring_dedup.HASHES)
        for d in docs:
            u.add(second([d])[0])
        later = substring_dedup.Survivors(20, [t.twice, u.twice])
        starts = later(docs)[1]
        for k in range(3):
            assert set(range(200 * k + 50, 200 * k + 56)) <= set(starts.tolist())
        assert len(starts) < 100


def test_levels():
    assert substring_dedup.levels(20) == [5, 10] and substring_dedup.levels(80) == [5, 10, 20, 40] and substring_dedup.levels(7) == []


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    path = p.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path), bpe.Encoder(path)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab  \n\t'sdre.!1 éü中\r😀\x1c\x85the<|endoftext|>"), st.text("aehinorst ", max_size=60)))
def test_bpe_is_exact(tokenizers, s):
    library, mine = tokenizers
    ids = library.encode(s, add_special_tokens=False).ids
    assert mine.encode(s) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False) == mine.run(s)[2].decode()


def test_bpe_special_and_long(tokenizers):
    library, mine = tokenizers
    for s in ("", "<|endoftext|>", "a<|endoftext|> b  <|endoftext|>", "x" * 5000, " " * 300 + "y", "ab\n" * 2000):
        assert mine.encode(s) == library.encode(s, add_special_tokens=False).ids


def test_bpe_decodes_the_ids_of_the_document(tokenizers, monkeypatch):
    library, mine = tokenizers
    for s in ("one two  three", "a<|endoftext|> b", "é 中\n"):
        ids, n, raw = mine.run(s)
        assert raw == s.encode() == b"".join(mine.token[int(i)] for i in ids.split(",")) and n == len(ids.split(","))
    # a fault in putting the pieces' ids together shows in the decoded text
    monkeypatch.setattr(mine, "piece", lambda p: str(mine.encode("x")[0]) if p == "\n" else "0")
    ids, _, raw = mine.run("one  two ")
    assert raw == b"".join(mine.token[int(i)] for i in ids.split(",")) != b"one  two "


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text("ab  \n\t'sdre.!1 éü中\r😀\x00\x1c\x85the<|endoftext|>", max_size=80), st.text("aehinorst ", max_size=80)), max_size=12))
def test_bpe_of_words_together_is_exact(tokenizers, texts):
    library, mine = tokenizers
    mine.forget()
    for t, (ids, n, raw) in zip(texts, map(mine.run, mine.learned(iter(texts))), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want) and raw == t.encode()


def test_bpe_encodes_new_words_together(tokenizers, monkeypatch):
    _, mine = tokenizers
    mine.forget()
    rng = random.Random(5)
    text = "x " + " ".join("".join(rng.choices("aeinorstlé", k=rng.randint(1, 30))) + rng.choice(["", ".", "!!", ",\nB"]) for _ in range(3000))
    want = mine.run(text)
    mine.forget()
    one_by_one = []
    monkeypatch.setattr(mine.words, "make", lambda w: one_by_one.append(w) or mine._ids(w))
    assert [mine.run(t) for t in mine.learned(iter([text]))] == [want]
    assert len(one_by_one) <= 20  # the text's first word, and pieces of more than LONGEST characters
    pairs = np.array([(rng.choice(list(mine.parts)), rng.choice(list(mine.parts))) for _ in range(3000)] + list(mine.rank)[:1000])
    assert mine.together.neighbours(pairs[:, 0], pairs[:, 1]).tolist() == [mine.neighbours(a, b) for a, b in pairs.tolist()]


def test_targets():
    sizes, weights = {"a": 10, "b": 100, "c": 100}, {"a": 3, "b": 1, "c": 2}
    got = mixing.targets(sizes, weights)
    assert got["a"] == 30 and got["b"] == pytest.approx(60) and got["c"] == pytest.approx(120)
    assert sum(mixing.targets({"a": 0, "b": 5}, {"a": 1, "b": 2}).values()) == 5


def test_flow_is_cheapest():
    # the pattern that only b may use should be taken first by b, so that a gets the shared words
    supply = {("a", "b"): 10, ("b",): 10}
    got = mixing.min_cost_flow(supply, {"a": 10, "b": 10})
    assert got[(("a", "b"), "a")] == 10 and got[(("b",), "b")] == 10 and got[(("a", "b"), "b")] == 0
    assert sum(mixing.min_cost_flow({("a",): 5}, {"a": 99}).values()) == 15


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        payload = bytes(i % 251 for i in range(n))
        assert warc.dechunk(warc.chunked(payload)) == payload
    assert warc.dechunk(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc")


def test_records_with_the_version_line_inside():
    payload = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 3
    stream = b"".join(r + b"\r\n\r\n" for p in (1, 2) for r in warc.records(p, "http://x", payload, None, 40))
    pieces = [("f", x) for x in stream.split(warc.VERSION)]
    got = list(warc.blocks(iter(pieces)))
    whole = b"".join(b for _, b in got[: len(got) // 2])
    assert warc.dechunk(whole.partition(b"\r\n\r\n")[2]) == payload
    with pytest.raises(ValueError):
        list(warc.blocks(iter([("f", stream[:-60].split(warc.VERSION)[-1])])))


WEIGHTS = {"word": 1.0, "tag": -2.0, "p": -0.5, "div": -4.0, "a": -4.0, "li": -4.0}


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>one two<p>three", "one two\n\nthree"),
        ("<nav><a>x</a><a>y</a></nav><article><h1>T</h1><p>a &amp; b\n c</p></article><footer>f g h</footer>", "T\n\na & b c"),
        ("<body><div class='ad'>buy</div><p>long text of the page here<script>var x='<p>no</p>'</script><div id=comments><p>nice post and many more words</div>", "long text of the page here"),
        ("<article><p>text <b>bold</b> more<aside>side</aside></p><form>in<input></form><p>end</article>", "text bold more\n\nend"),
        ("<!-- c --><p>a<br>b &lt;tag&gt; &#233;</p>", "a b <tag> é"),
    ],
)
def test_main_text(page, want):
    assert html.Page(page).main_text(WEIGHTS) == want


LONG = "the text of this page has many words that a reader came for"


@pytest.mark.parametrize("wrap", ["div class='content with-sidebar'", "div class='page no-ads'", "div id='search-results'", "div class='sidebar'", "form id=aspnet", "div aria-label='page with comments'", "div class='content search'"])
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<main><p>{}</p></main>", "<p>{}</p>"])
def test_wrappers_are_no_furniture(wrap, inner):
    page = f"<body><nav><a>x</a></nav><{wrap}>{inner.format(LONG)}<div class='ad'>buy</div></{wrap.split()[0]}><footer>f g</footer></body>"
    assert html.Page(page).main_text(WEIGHTS) == LONG


def test_furniture_beside_an_article_stays_out():
    for other in ("<div class='related'><article>a teaser</article></div>", "<section id=comments><p>" + LONG * 3 + "</section>", "<aside><article>" + LONG * 2 + "</article></aside>", "<article class='comment-body'>" + LONG * 2 + "</article>", "<div class='nav-menu'>" + LONG * 2 + "</div>"):
        assert html.Page(f"<body><article><p>{LONG}</p></article>{other}</body>").main_text(WEIGHTS) == LONG


def test_text_of_embedded_elements_is_kept():
    page = "<article><p>one <math><mi>x</mi></math> two</p><object data=a><p>three</p></object><noscript><p>four</p></noscript><svg><text>no</text></svg></article>"
    assert html.Page(page).main_text(WEIGHTS) == "one x two\n\nthree\n\nfour"


@settings(deadline=None)
@given(st.text("<>/pdiva =\"'!-&;x", max_size=80))
def test_any_markup_is_parsed(s):
    assert isinstance(html.Page(s).main_text(WEIGHTS), str)


@given(st.lists(st.sampled_from(["<p>", "</p>", "w w w", "<a>", "x"]), max_size=12))
def test_region_is_the_largest_sum(parts):
    page = html.Page(" ".join(parts))
    s = page.scores(WEIGHTS)
    best = max([0.0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
    a, b = page.region(WEIGHTS)
    assert sum(s[a:b]) == pytest.approx(best)


def test_learned_tags_are_negative():
    page = "<html><head><title>t</title></head><body><nav><a>x</a></nav><article><p>" + "word " * 50 + "</p></article><footer>f</footer>"
    w = html.learn([page] * 5)
    assert w["word"] > 0 and all(v < 0 for k, v in w.items() if k != "word") and w["a"] < w["p"]
    assert entities.unescape("&amp;") == "&"


def test_toxic_words_are_learned():
    rng = random.Random(3)
    plain = [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ne", "ro", "ti") for c in ("sa", "vu", "x")]
    doc = lambda bad: " ".join(rng.choice(["scumbag", "idiot"]) if bad and rng.random() < 0.1 else rng.choice(plain) for _ in range(80))
    m = toxicity.fit_texts([doc(True) for _ in range(60)], [doc(False) for _ in range(120)])
    good, bad = [m.score(doc(False)) for _ in range(20)], [m.score(doc(True)) for _ in range(20)]
    assert np.mean(bad) > np.mean(good) + 0.5
    assert 0 <= m.score("") <= 1 and m.score(None) == m.score("")
    assert 0 <= toxicity.fit_texts([], []).score("x") <= 1


def _late(rng, bad, n=2500):
    """A text of three parts, plain words of its own in each, whose toxic wording comes after all of them."""
    ws = [f"{rng.choice('klmn')}{rng.choice('aeiou')}{rng.choice('rst')}{rng.choice('aeiou')}{3 * i // n}" for i in range(n)]
    return " ".join(ws + [rng.choice(["scumbag", "idiot", "moron"]) if bad and rng.random() < 0.3 else "zu" for _ in range(60)])


def test_toxic_words_are_learned_from_whole_texts():
    rng = random.Random(4)
    m = toxicity.fit_texts([_late(rng, True) for _ in range(30)], [_late(rng, False) for _ in range(60)])
    assert b"scumbag" in m.toxic and b"idiot" in m.toxic
    # the ordinary dictionary knows the end of its texts, and calibration has seen as many windows as scoring does
    assert b"zu zu" in m.ordinary and all(w in m.ordinary for w in (b"0 ", b"1 ", b"2 "))
    good, bad = [m.score(_late(rng, False)) for _ in range(10)], [m.score(_late(rng, True)) for _ in range(10)]
    assert min(bad) > 0.7 > max(good)


def test_every_vector_is_in_a_list():
    rng = np.random.default_rng(0)
    for x in (rng.normal(size=(500, 8)), np.repeat(rng.normal(size=(3, 8)), 100, axis=0), rng.normal(size=(1, 8)), rng.normal(size=(300, 8)) * rng.choice([1e-3, 1, 1e150], size=(300, 1))):
        index = ann.build(x, max(1, len(x) // 16), float(np.sqrt(((x / 1e150) ** 2).sum(1).max()) * 1e150))
        lists = index.lists_of(x)
        assert all(1 <= len(n) <= ann.COPIES and len(set(n.tolist())) == len(n) for n in lists)
        assert all(np.isfinite(index.centroids).ravel()) and all(len(p) for p in index.probes(x[:5]))


def test_lists_are_those_of_the_nearest_centroids():
    x = np.random.default_rng(5).normal(size=(4000, 16))
    index = ann.build(x, 250, float(np.linalg.norm(x, axis=1).max()))
    d = ((index.lift(x)[:, None, :8] - index.centroids[None, :, :8]) ** 2).sum(2)  # in two halves, to save memory
    d += ((index.lift(x)[:, None, 8:] - index.centroids[None, :, 8:]) ** 2).sum(2)
    assert np.mean([n[0] == m for n, m in zip(index.lists_of(x), d.argmin(1), strict=True)]) > 0.97


def test_probes_go_on_until_they_hold_enough():
    rng = np.random.default_rng(2)
    # two groups of three copies far from the rest, and a graph that leads nowhere
    x = np.r_[np.repeat(np.eye(6)[:2] * 50, 3, axis=0), rng.normal(size=(60, 6))]
    index = ann.build(x, 5, 50.0)
    n = len(index.centroids)
    index.graph, index.ratio = np.zeros((n, 1), int), 0.5
    index.homes = np.bincount([at[0] for at in index.lists_of(x)], minlength=n)
    for k in (2, 3, 5, 20, 60, 65, 1000):
        for p in index.probes(x[:6], k):
            assert len(set(p.tolist())) == len(p)
            assert index.homes[p].sum() > k or len(p) == n
            assert index.homes[p[:-1]].sum() <= k


HOSTILE = ["<a ", "<a '", '<a "', "<div>", "<b><div></div>", "</span>", "<svg>", "<!-", "<!--", "<", "</p ", "<article>", "<div class=ad>", "<p><b>", "<li><i>", "x <b>", "<main><nav>", "<table><td>", 'class="', "&amp"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    import time

    def took(n):
        page = "<article>" + piece * (n // len(piece)) + "<p>text"
        start = time.process_time()
        html.Page(page).main_text(WEIGHTS)
        return time.process_time() - start

    took(20_000)
    assert took(400_000) < 20


def test_a_block_of_links_does_not_cut_a_story():
    story = [" ".join(f"w{k}{i}" for i in range(60)) for k in range(2)]
    links = "<ul>" + "<li><a href=x>go</a></li>" * 30 + "</ul>"
    page = f"<body><div>{links}</div><p>{story[0]}</p>{links}<p>{story[1]}</p><div>{links}</div>"
    assert html.Page(page).main_text(WEIGHTS) == "\n\n".join(story)


@given(st.lists(st.sampled_from(["<p>", "</p>", "w w w", "<a>", "x"]), max_size=12))
def test_regions_are_maximal(parts):
    page = html.Page(" ".join(parts))
    s, found = page.scores(WEIGHTS), page.regions(WEIGHTS)
    assert all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
    best = page.region(WEIGHTS)
    if best[0] < best[1]:
        sums = [sum(s[a:b]) for a, b in found]
        assert max(sums) == pytest.approx(sum(s[best[0] : best[1]])) and min(sums) >= html.SHARE * max(sums) - 1e-9


def test_references_end_with_their_run():
    page = html.Page("<article><p>&<b>lt;</b> x &lt;b&gt; &am<i>p;</i> a&nbsp;b &#x41;&amp;lt;</p></article>")
    assert page.main_text({}) == "&lt; x <b> &am" + "p; a b A&lt;"
