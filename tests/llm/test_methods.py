"""The methods against brute force, exact round trips and independent implementations."""

import html.parser
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillspark.llm import ann, bpe, jpeg, licenses, media, minhash, packing, quality, substrings, wrappers

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", "é", "É", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "²", "!", "...", "ß", "漢字", "😀", "<|endoftext|>", "\x1c", "\x85", "́", "'", "Σ", "İ", "　", "the", " of", "\r\n"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(n)]


def test_bpe_equals_the_library():
    path = P.path("byte_bpe_50k.json")
    ours, theirs = bpe.load(path), tokenizers.Tokenizer.from_file(path)
    texts = [*random_texts(3000), "x" * 3000, "thereof" * 200, "ab" * 400]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        expected = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert ours.decode(ids) == theirs.decode(expected, skip_special_tokens=False)


def test_lockstep_equals_one_word_alone():
    ours = bpe.load(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoins hr", k=rng.randint(1, 64))).encode() for _ in range(300)]
    assert ours.encode_words(words) == [ours._alone(w) for w in words]


def test_chunked_ids_equal_whole_texts():
    encoder = packing.ChunkTokenizer(P.path("word_bpe_49k.json"), cache=50)
    assert encoder.apart and encoder.lower
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = random_texts(3000, 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not packing.ChunkTokenizer(P.path("byte_bpe_50k.json")).apart


def test_choice_minimises_the_sum_of_squares():
    rng = random.Random(5)
    packer = packing.SumOfSquares(64, 10_000, 0)
    for i in range(400):
        size = rng.randint(1, 63)
        count = packer.level.copy()
        best = packer.choose(size)

        def after(h, count=count, size=size):
            level = count.copy()
            level[h] -= h > 0
            level[h + size] += h + size < 64
            return int((level[1:64].astype(int) ** 2).sum())

        options = [h for h in range(1, 65 - size) if count[h]] + [0]
        assert after(best) == min(map(after, options))
        packer.add(i, b"\1\0\0\0" * size)


def test_pieces_cover_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    expected = {r.doc_id: np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes() for r in docs.collect()}
    got = packing.pack(docs.repartition(3), path, max_open=4).collect()
    for doc, ids in expected.items():
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == ids and all(r.doc_tokens == len(ids) // 4 for r in mine)
    for number in {r.sequence_id for r in got}:
        held = sorted((r for r in got if r.sequence_id == number), key=lambda r: r.offset)
        total = sum(r.length for r in held)
        assert [r.offset for r in held] == np.cumsum([0, *(r.length for r in held)])[:-1].tolist()
        assert 4096 - packing.SPARE <= total <= 4096 or total < 4096 and total & (total - 1) == 0
    plain = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pieces(docs).collect()}
    assert sum(plain.values()) > 0 and all(0 <= v < 2**32 for v in plain.values())


@pytest.mark.parametrize("parts", [1, 32])
def test_windows_are_filled_by_the_method_and_hardly_padded(parts):
    encoder = packing.tokenizer(P.path("word_bpe_49k.json"))
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()
    ids = [x + b"\2\0\0\0" for begin in range(0, len(texts), 1000) for x in encoder.encode([t or "" for t in texts[begin : begin + 1000]])]
    total, cut, pieces, padding = sum(map(len, ids)) // 4, 0, 0, 0
    for part in range(parts):
        packer = packing.SumOfSquares(4096, packing.MAX_OPEN, 0)
        for i in range(part * len(ids) // parts, (part + 1) * len(ids) // parts):
            packer.add(i, ids[i])
        packer.finish()
        fill: dict[int, int] = {}
        for piece, number, offset in packer.closed:
            assert fill.get(number, 0) == offset
            fill[number] = offset + len(piece[2]) // 4
        cut, pieces = cut + packer.cut, pieces + len(packer.closed)
        padding += sum(4096 - f for f in fill.values() if f & (f - 1))
        assert max(fill.values()) <= 4096
    assert cut < 0.05 * total and padding < 0.01 * total and pieces < 1.1 * len(ids)


@pytest.mark.parametrize("low, high, dense", [(-256, 0, 1), (-300, 300, 1), (-2, 3, 1), (-3, 4, 0.05), (-1, 2, 0.02)])
def test_coefficients_survive_the_scans(low, high, dense):
    rng = np.random.default_rng(0)
    grids = [(int(rng.integers(1, 4)), int(rng.integers(1, 5))) for _ in range(8)]
    n = sum(6 * r * c for r, c in grids)
    blocks = (rng.integers(low, high, (n, 64)) * (rng.random((n, 64)) < dense)).astype(np.int32)
    _, found, _ = jpeg.coefficients(jpeg.encode(grids, blocks, [b""] * 8))
    assert (found == blocks).all()


def test_scans_without_restart_markers_and_with_runs_of_ended_blocks():
    """A grey image of three blocks, written here bit by bit: one lane a scan, an end-of-band run over blocks."""
    ac, codes = jpeg.code_of({0x00: 2, 0x10: 2, 0x01: 2, 0x02: 3, 0xF0: 4})
    dc, dc_codes = jpeg.code_of({s: 4 for s in range(12)})
    put = lambda pairs: "".join(f"{c:0{n}b}" for c, n in pairs if n)

    def packed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    seg = jpeg._segment
    head = seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0])) + seg(0xC4, b"\0" + dc + b"\x10" + ac)
    scan = lambda lo, hi, bits, data: seg(0xDA, bytes([1, 1, 0, lo, hi, bits])) + data
    first = packed(put([dc_codes[2], (3, 2), dc_codes[0], dc_codes[1], (0, 1)]))  # 3, 3, 2 (difference -1)
    band = packed(put([codes[0x02], (2, 2), codes[0x10], (1, 1)]))  # block 0: k=1 is 2, then a run of three ended blocks
    more = packed(put([codes[0x10], (1, 1), (1, 1)]))  # refinement: three ended blocks, the old one's bit
    data = b"\xff\xd8" + head + scan(0, 0, 0, first) + scan(1, 63, 1, band) + scan(1, 63, 0x10, more) + b"\xff\xd9"
    images, blocks, base = jpeg.coefficients([data])
    assert blocks[:, 0].tolist() == [3, 3, 2] and blocks[0, 1] == 5 and not blocks[1:, 1:].any()
    assert jpeg.tensors(images, blocks, base)[0].shape == (8, 24, 3)


def test_transform_and_chroma():
    blocks = np.zeros((6, 64), np.int32)
    blocks[:4, 0], blocks[4, 0], blocks[5, 0] = 8 * 20, 0, 8 * 50  # Y 148, Cb 128, Cr 178
    images, found, base = jpeg.coefficients(jpeg.encode([(1, 1)], blocks, [b""]))
    rgb = jpeg.tensors(images, found, base)[0]
    assert rgb.shape == (16, 16, 3) and (rgb == np.array([148 + 70, 148 - 36, 148])).all()
    rng = np.random.default_rng(1)
    one = rng.integers(-40, 40, (1, 64)).astype(float)
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * u[:, None] + 1) * u * np.pi / 16)
    square = np.zeros(64)
    square[jpeg.ZIGZAG] = one[0]
    expected = np.clip(basis @ square.reshape(8, 8) @ basis.T + 128, 0, 255)
    assert np.abs(jpeg._samples(one).reshape(8, 8) - expected).max() <= 0.6


def test_payloads_come_back():
    texts = ["", "a", "x" * 63, "y" * 64, "z" * 65, "é漢😀" * 50, "\0\0"]
    found, rgb = media.read(media.write([media.payload(t) for t in texts]))
    assert found == [media.payload(t) for t in texts] and len(rgb) == len(texts)


def shape_of(*pages):
    found = [wrappers.parse(*wrappers.expression(p)) for p in pages]
    return wrappers.write(wrappers.join(found) if len(found) > 1 else found[0])[0]


def test_wrapper_alignment():
    pages = ["<ul><li>1<li>2<li>3</ul><p>x", "<ul><li>1</ul><div class='ad'>q</div><p>x<p>y"]
    both = shape_of(*pages)
    assert both == ".ul +li .# / / ?div.ad .# / +p .# /"
    assert shape_of(*pages, pages[0]) == both == shape_of(*pages, pages[1])
    assert shape_of("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><h2>e</h2><p>f</p>") == "+( .h2 .# / .p .# / /"
    long = [f"<{t}>x</{t}>" for t in "h2 p ul div pre section table".split()]
    assert shape_of("".join(long * 3)).count("section") == 1
    assert shape_of("".join(long * 2), "".join(long)).startswith("+( .h2")


def test_common_subsequence_equals_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = wrappers.common(a, b)
        assert len(found) == best[-1][-1] and all(a[i] == b[j] for i, j in found)
        assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))


TEMPLATE = """<html><head><title>T</title><script>if (a < b) "<p>no</p>"</script></head><body><div class="cookie-notice">We use cookies</div><header>Site</header>
<nav><a href=1>home</a></nav><aside>side</aside><{box}><h1>{title}</h1><p>First &amp; {a}<br>line</p><div class="advert">buy</div><ul><li>one</li><li>two</li></ul><form>f</form><p>Last</p></{end}>
<section id="comments"><p>nice post</p></section><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("box, end", [("article", "article"), ("main", "main"), ("div class='post-body content'", "div"), ("div", "div")])
def test_article_and_nothing_else(spark, box, end):
    pages = [(i, f"http://host-{end}{len(box)}.example/{i}", TEMPLATE.format(box=box, end=end, title=f"Title {i}", a="b" * (i + 50))) for i in range(6)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[2] == f"Title 2\n\nFirst & {'b' * 52} line\n\none\n\ntwo\n\nLast"


def main_texts(spark, pages):
    return {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("url", ["http://two.example/", None])
def test_pages_of_one_host_in_several_layouts(spark, url):
    boxes = ["article", "main", "div class='content'", "div class='x'", "section"]
    page = "<body><nav>n</nav><{box}><h2>Title {i}</h2><p>{text}</p></{end}><footer>f</footer></body>"
    pages = [(i, url and f"{url}{i}", page.format(box=box, end=box.split()[0], i=i, text="w" * (40 + i))) for i, box in enumerate(boxes * 3)]
    assert main_texts(spark, pages) == {i: f"Title {i}\n\n{'w' * (40 + i)}" for i in range(15)}


def test_parts_outside_the_largest_container_stay(spark):
    pages = [(i, "http://parts.example/", f"<body><div>menu of all</div><div class='x'><p>long {'w' * (400 + i)}</p></div><div class='y'><p>short {i}</p></div></body>") for i in range(6)]
    assert main_texts(spark, pages) == {i: f"long {'w' * (400 + i)}\n\nshort {i}" for i in range(6)}


def test_template_text_goes_and_texts_of_pages_stay(spark):
    page = "<body><article><h1>Title {i}</h1><div class='x0'>House rules apply</div>{own}<p>Same</p><p>{text}</p><div id='y'><p>All hands read</p></div></article></body>"
    own = "<div class='z'>Seldom</div>"
    pages = [(i, "http://template.example/", page.format(i=i, own=own if i < 3 else "", text="w" * (40 + i))) for i in range(6)]
    assert main_texts(spark, pages) == {i: f"Title {i}\n\n{'Seldom' + chr(10) * 2 if i < 3 else ''}Same\n\n{'w' * (40 + i)}" for i in range(6)}
    assert set(main_texts(spark, [(i, "http://copies.example/", pages[0][2]) for i in range(4)]).values()) == {f"Title 0\n\nHouse rules apply\n\nSeldom\n\nSame\n\n{'w' * 40}\n\nAll hands read"}


@pytest.mark.parametrize("box", ["content no-sidebar", "layout with-sidebar", "has-header", "page-with-menu", "layout sidebar", "header"])
@pytest.mark.parametrize("tag", ["article", "section"])
def test_elements_around_the_article_stay(spark, box, tag):
    page = "<body><p>site {n}</p><div class='{box}'><{tag}><h1>Title {i}</h1><p class='side-note'>Note {i}</p><p class='related-work'>{text}</p><div class='social-share'>share {i}</div></{tag}></div></body>"
    pages = [(i, "http://around.example/", page.format(box=box, tag=tag, i=i, n=1, text="w" * (40 + i))) for i in range(6)]
    assert main_texts(spark, pages) == {i: f"Title {i}\n\nNote {i}\n\n{'w' * (40 + i)}" for i in range(6)}


def test_articles_of_comments_are_no_roots(spark):
    page = "<body><div><p>{text}</p></div><div class='comments'><article>nice {i} {long}</article></div><div class='sidebar-content'>{i}</div></body>"
    pages = [(i, "http://blog.example/", page.format(i=i, text="w" * (40 + i), long="c" * 400)) for i in range(6)]
    assert main_texts(spark, pages) == {i: f"{'w' * (40 + i)}\n\n{i}" for i in range(6)}


class Articles(html.parser.HTMLParser):
    """The text of a page's article elements by the standard library's parser: a plain page-alone extractor."""

    BLOCKS = {"p", "h1", "ul", "li", "article", "div", "nav", "footer"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [[]], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append([])
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BLOCKS:
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)

    def text(self):
        return "\n\n".join(b for b in (" ".join("".join(x).split()) for x in self.blocks) if b)


def test_pages_of_the_tables_equal_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: (r.text, r.n_chars) for r in wrappers.op5_wrappers(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for r in pages:
        expected = Articles(r.html).text()
        assert got[r.page_id] == (expected, len(expected))


def test_pages_without_telling_names_need_the_wrapper(spark):
    page = "<body><div><p>Menu of this site with many words that stand on every page of it</p></div><section><p>{text}</p></section><div><p>Imprint and more words that stand on every page of it</p></div></body>"
    pages = [page.format(text=f"text {i} {'w' * (30 + i)}") for i in range(5)]
    got = main_texts(spark, [(i, "http://plain.example/", p) for i, p in enumerate(pages)])
    assert got == {i: f"text {i} {'w' * (30 + i)}" for i in range(5)}
    alone = [wrappers.extract(p, wrappers.prepared(s, wrappers.decide(wrappers.parse(s, t)))) for p in pages for s, t in [wrappers.expression(p)]]
    assert all("Menu" in a for a in alone)


def test_article_text_with_telling_class_names_stays(spark):
    page = "<body><nav>n</nav><article><header><h1>Title {i}</h1></header><p class='notice-board'>Board {i}</p><div class='share-price'>Price {i}</div><div class='note promotion'>Note {i}</div><p>{text}</p><div class='ad'>buy {i}</div></article></body>"
    pages = [(i, "http://names.example/", page.format(i=i, text="w" * (40 + i))) for i in range(5)]
    assert main_texts(spark, pages) == {i: f"Title {i}\n\nBoard {i}\n\nPrice {i}\n\nNote {i}\n\n{'w' * (40 + i)}" for i in range(5)}


@pytest.mark.parametrize("cards", ["inside", "beside"])
def test_a_main_with_teaser_cards_keeps_its_text(spark, cards):
    card = "<article><a href='x'>More {i}</a></article>"
    page = f"<body><main><h1>Title {{i}}</h1><p>{{text}}</p>{card if cards == 'inside' else ''}</main>{card if cards == 'beside' else ''}</body>"
    pages = [(i, "http://cards.example/", page.format(i=i, text="w" * (40 + i))) for i in range(5)]
    got = main_texts(spark, pages)
    assert all(got[i].startswith(f"Title {i}\n\n{'w' * (40 + i)}") for i in range(5))


def test_named_headings_and_signatures_that_all_pages_have_stay(spark):
    page = "<body><div class='top'>Site of all</div><article><h1>Title {i}</h1><h2 class='wp-heading'>Summary</h2><p>{text}</p><p class='sig'>By the desk.</p></article></body>"
    pages = [(i, "http://sig.example/", page.format(i=i, text="w" * (40 + i))) for i in range(6)]
    assert main_texts(spark, pages) == {i: f"Title {i}\n\nSummary\n\n{'w' * (40 + i)}\n\nBy the desk." for i in range(6)}


def test_headline_in_main_and_controls_in_prose_stay(spark):
    page = "<body><main><h1>Headline {i}</h1><p>Standfirst {i}</p><article><p>Press <button>Save</button> to <label>store</label><script>x()</script> {text}</p><div><button>Share</button></div><form><p>Name <label>Mail</label></p></form></article><p>More {i}</p></main></body>"
    pages = [(i, "http://main.example/", page.format(i=i, text="w" * (80 + i))) for i in range(6)]
    assert main_texts(spark, pages) == {i: f"Headline {i}\n\nStandfirst {i}\n\nPress Save to store {'w' * (80 + i)}" for i in range(6)}
    assert wrappers.extract(pages[2][2]) == f"Headline 2\n\nStandfirst 2\n\nPress Save to store {'w' * 82}"


def test_rules_of_large_pages_take_linear_time():
    import time

    page = "<body>" + "".join(f"<div class='a{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>{i}" for i in range(10_000)) + "</body>"
    shape, told = wrappers.expression(page)
    began = time.perf_counter()
    wrappers.decide(wrappers.parse(shape, told))
    assert time.perf_counter() - began < 3


def test_pages_of_any_depth(spark):
    pages = [(0, "http://a.example/", "<div>" * 20_000 + "deep"), (1, "http://a.example/", "<p>x</p>" + "<font>" * 20_000 + "y"), (2, "http://a.example/", "<ul><li>" * 10_000 + "z"), (3, "http://b.example/", "<font>" * 1200 + "u"), (4, "http://b.example/", "<font>" * 1201 + "v"), (5, "http://b.example/", "".join(f"<p class=c{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}>{i}</p>" for i in range(3000)))]
    got = main_texts(spark, pages)
    assert [got[i] for i in range(5)] == ["deep", "x\n\ny", "z", "u", "v"] and got[5] == "\n\n".join(map(str, range(3000)))


def test_license_spans():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    mit = licenses.TEMPLATES["mit-text"]
    text = "é intro. " + mit.replace("free of charge, ", "").replace("merge,", "merge and") + " end"
    [(name, coverage, begin, end)] = scanner.scan([text])[0]
    assert name == "mit-text" and 0.9 < coverage < 1 and text[begin:end].startswith("Permission") and text[begin:end].endswith("Software.")
    assert [m[0] for m in scanner.scan(["All rights reserved. x All rights reserved."])[0]] == ["all-rights-reserved"] * 2
    assert scanner.scan(["rights all reserved", "", "mit license"]) == [[], [], []]


@pytest.mark.parametrize("text", ["Released under the BSD License.", "Licensed under the BSD License.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY 3.0.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3."])
def test_licenses_without_a_template_are_none(text):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert scanner.scan([f"words before {text} words behind"]) == [[]]
    short = {k: v for k, v in licenses.TEMPLATES.items() if len(v.split()) <= licenses.SHORT}
    assert [[m[0] for m in ms] for ms in scanner.scan([f"words before {v} words behind" for v in short.values()])] == [[k] for k in short]


def test_fingerprints_find_what_aligning_everywhere_finds():
    rng = random.Random(9)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    filler = [f"filler{i}" for i in range(500)]
    texts = []
    for name, template in licenses.TEMPLATES.items():
        for dropped in (0, 0.1, 0.4):
            words = [w for w in template.split() if rng.random() >= dropped]
            texts.append(" ".join([*rng.choices(filler, k=rng.randint(0, 30)), *words, *rng.choices(filler, k=rng.randint(0, 30))]))
    for text, matches in zip(texts, scanner.scan(texts), strict=True):
        words = np.array([h for w in text.split() if (h := licenses._hash(w))], np.uint64)
        best = 0.0
        for k, template in enumerate(scanner.words):
            matched, begin, end = licenses.align(template, words, -len(template), len(words), scanner.bands[k])
            if end - begin < len(template) + 2 * scanner.bands[k] and scanner._named(k, words[begin : end + 1].tolist()):
                best = max(best, matched / len(template))
        if best >= 0.93 or best < licenses.COVERAGE:  # between those a band may be too narrow for all that is left out
            assert bool(matches) == (best >= licenses.COVERAGE), (best, matches, text)
        assert not matches or max(m[1] for m in matches) <= best + 1e-9


def test_alignment_equals_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a = [rng.randint(1, 4) for _ in range(rng.randint(1, 9))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(1, 9))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got = licenses.align(np.array(a, np.uint64), np.array(b, np.uint64), -1, 1)
        assert got[0] == table[-1][-1]


def test_long_texts_of_notice_words_take_little_time():
    import time

    scanner = licenses.Scanner(licenses.TEMPLATES)
    notice = licenses.TEMPLATES["agpl-3.0-notice"]
    shuffled = notice.split() * 620
    random.Random(3).shuffle(shuffled)
    for text in (" ".join(shuffled), " ".join([notice] * 500), "the software is " * 25_000):
        assert len(text) > 190_000
        began = time.perf_counter()
        scanner.scan([text])
        assert time.perf_counter() - began < 5


def test_factorisation_identity():
    machine = quality.Machine()
    rng = np.random.default_rng(0)
    machine.linear = rng.normal(size=machine.linear.shape)
    machine.factors = rng.normal(size=machine.factors.shape)
    slots, values = quality.features("Some words, some WORDS!! and 12 more\nlines")
    pairs = sum(machine.factors[slots[i]] @ machine.factors[slots[j]] * values[i] * values[j] for i in range(len(slots)) for j in range(i))
    z, _ = machine.raw(slots, values, np.array([0]))
    assert z[0] == pytest.approx(machine.linear[slots] @ values + pairs)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) for d in got.doc_id)


def test_gear_hash_is_rolling():
    raw = np.frombuffer(b"the quick brown fox jumps over the lazy dog", np.uint8)
    h = substrings.gear(raw)
    for i in range(len(raw)):
        expected = sum(int(substrings.GEAR[raw[i - j]]) << j for j in range(min(i + 1, substrings.REACH))) % 2**64
        assert int(h[i]) == expected


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("tion an er ly ing re ed st nd wh".split()) + rng.choice("th of and in on is at".split()) + str(rng.randint(0, 99)) for _ in range(n)]


def test_passages_go_and_clean_documents_stay(spark):
    passage = " ".join(words(60, 0))
    short = " ".join(words(15, 99))
    docs = [(i, " ".join(words(80, i + 1)) + " " + (passage if i in (3, 5, 7) else short) + "\n" + " ".join(words(70, i + 200))) for i in range(10)]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [i for i, r in got.items() if passage in r.text] == [3]
    assert {i for i, r in got.items() if r.removed} == {5, 7}
    for i in (5, 7):
        gone = sum(len(docs[i][1][s.begin : s.end].split()) for s in got[i].removed)
        assert 30 <= gone <= 60 and all(docs[i][1][s.begin : s.end].strip() in passage for s in got[i].removed)
    assert all(got[i].text == docs[i][1] for i in (0, 1, 2, 3, 4, 6, 8, 9))


def test_dedup_equals_brute_force(spark):
    """All documents of sf0.01: chunks held by a document of lesser id, runs of 25 words of them cut, by plain dictionaries."""
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    first: dict[int, int] = {}
    for r in docs:
        for d in substrings.digests(r.text or "").tolist():
            first[d] = min(first.get(d, r.doc_id), r.doc_id)
    got = {r.doc_id: r for r in substrings.op8_substrings(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for r in docs:
        raw, edges, counts = substrings.chunks(r.text or "")
        again = [first[d] != r.doc_id for d in substrings.digests(r.text or "").tolist()]
        spans, run = [], []
        for i, repeat in enumerate([*again, False]):
            if repeat:
                run.append(i)
                continue
            if run and sum(counts[k] for k in run) >= 25:
                spans.append((edges[run[0]], edges[run[-1] + 1]))
            run = []
        expected, end = b"", 0
        for begin, stop in spans:
            expected, end = expected + raw[end:begin], stop
        assert got[r.doc_id].text == (expected + raw[end:]).decode() and got[r.doc_id].n_removed == len(spans)
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_boundaries_resist_insertions():
    base = " ".join(words(600, 5))
    a, b = substrings.digests(base), substrings.digests("new words here " + base)
    assert len({*a.tolist()} & {*b.tolist()}) >= len(a) - 3


def edited(ws, n, seed):
    rng, out = random.Random(seed), [*ws]
    for k in rng.sample(range(len(ws)), n):
        out[k] = f"edit{seed}x{k}"
    return out


def test_classes_equal_brute_force(spark):
    docs = [" ".join(edited(words(120, g), e, 10 * g + e)) for g in range(6) for e in (0, 1, 2, 3, 5, 8, 12)] + [" ".join(words(100, 900 + i)) for i in range(20)]
    docs += docs[:3]
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    total, counts = minhash.document_frequencies(df)
    assert total == len(docs)
    shingler = minhash.Shingler(minhash.rarities(total, counts))
    sets = [shingler.weighted(w) for w in shingler.words(docs)]
    label = [*range(len(docs))]
    for i in range(len(docs)):
        for j in range(i):
            if minhash.jaccard(sets[i], sets[j]) >= 0.8 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == dict(enumerate(label))


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 400).astype(np.uint64), rng.integers(0, 2**63, (2, 100)).astype(np.uint64)
    weights = lambda h: 0.5 + (h % np.uint64(7)).astype(float)
    sets = [(h := np.sort(np.concatenate([shared, own[i]])), weights(h)) for i in range(2)]
    drawn = np.array([minhash.Sampler().draw(sets)])
    agree = (drawn[0, 0] == drawn[0, 1]).mean()
    assert abs(agree - minhash.jaccard(*sets)) < 0.25


def true_neighbours(ids, x, q, k=20):
    found = {}
    for i in np.flatnonzero(q):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s))[: 2 * k] if j != i][:k]
        found[int(ids[i])] = [int(ids[j]) for j in order]
    return found


def searched(df, **how):
    from pyspark.sql import functions as F

    got: dict[int, list] = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_recall_at_two_thousand_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    truth = true_neighbours(ids, x, ids % 20 == 0)
    got = searched(df)
    assert np.mean([len({*got[i]} & {*truth[i]}) / 20 for i in truth]) >= 0.95
    assert searched(df, exact=True) == truth


def test_exact_search_of_clustered_and_huge_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 800)] * 3 + rng.normal(size=(800, 6)) * 0.2
    ids = np.arange(800)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    truth = true_neighbours(ids, x, ids % 20 == 0)
    assert searched(df, exact=True) == truth
    approximate = searched(df)
    assert np.mean([len({*approximate[i]} & {*truth[i]}) / 20 for i in truth]) >= 0.9
    for power in (600, -600):  # the same vectors, near the ends of double precision
        scaled = spark.createDataFrame([(int(i), np.ldexp(v, power // 2 + (200 if power > 0 else -200)).tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
        assert searched(scaled, exact=True) == truth
    odd = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1.0]), (2, [1e-200, 0.0]), (3, [-1e200, 0.0]), (20, [1e-200, 1e-200]), (21, [1.0, 2.0]), (40, [1.0, 2.0, 3.0]), (41, [3.0, 2.0, 1.0])], "vec_id long, embedding array<double>")
    assert searched(odd) == {0: [1, 21, 2, 20, 3], 20: [0, 1, 21, 2, 3], 40: [41]}


def test_hypothesis_tests_abandon_candidates():
    """Shares of pairs that are abandoned before their last dimension, and of lists probed, at two sizes."""
    rng = np.random.default_rng(6)
    shares = []
    for n in (2_000, 20_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        index = ann.Index(x[:5_000], 0, 1.0 + 1e-12, round(np.sqrt(n) / 2))
        lists, square = index.assign(x)
        count = np.bincount(lists, minlength=len(index.centres))
        index.know(np.arange(len(count)), count, np.bincount(lists, square, len(count)) / np.maximum(count, 1), np.sqrt(np.array([square[lists == i].max(initial=0) for i in range(len(count))])))
        q = x[:100]
        limit = 2 - 2 * np.sort(q @ x.T, axis=1)[:, -40]  # about what a nearest list gives
        i, probed = index.probes(q, limit, ann.RECALL)
        kept, _, abandoned, every = index.scan(q, x, 21, limit)
        assert abandoned / every > 0.4 and len(kept) / every < 0.05
        shares.append(count[probed].sum() / (len(q) * n))
    assert shares[1] < shares[0] < 1


def test_recall_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    from pyspark.sql import functions as F

    got: dict[int, list] = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for i, q in zip(ids, x, strict=True):
        if i % 20:
            continue
        s = x @ q
        s[ids == i] = -np.inf
        hits += len({r.vec_id for r in got[i]} & {*ids[np.lexsort((ids, -s))[:20]].tolist()})
        total += 20
        assert [r.rank for r in got[i]] == [*range(1, 21)]
        assert all(r.score == pytest.approx(float(x[ids == r.vec_id][0] @ q), abs=1e-12) for r in got[i])
    assert hits / total >= 0.9
