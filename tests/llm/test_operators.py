"""The operators against brute force on small tables with the awkward cases in them."""

import hashlib
import html as htmllib
import io
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, same
from pyspark.sql import functions as F

from corpusql.llm import queries as Q
from corpusql.llm.decontaminate import decontaminate
from corpusql.llm.html import ASIDE_WORDS, ASIDES, BESIDE, BLOCKS, FULL, LEVEL, OUTSIDE_ONLY, VOID, extract, extract_pages, nodes_of, step, style_tree
from corpusql.llm.line_dedup import line_dedup
from corpusql.llm.lm_score import Settings, Where, model_of, prefix_code, score_documents, training_counts, vocabulary, write_tables
from corpusql.llm.near_dedup import components, near_duplicates
from corpusql.llm.packing import pack_documents, padding
from corpusql.llm.quality import quality_rules
from corpusql.llm.secrets import COMPLETE, KINDS, PATTERNS, scan
from corpusql.llm.token_files import token_table
from corpusql.llm.vectext import SPACED_LOWER, blocks
from corpusql.llm.warc import archive_table, build_dictionary, parse as parse_archive, write_archives

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, equal rows, a repeated id, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "a b c\nd e f", "x"), (1, "a b c\nd e f", "x"), (2, None, None), (None, "null id " * 30, "y"), (3, "", "z"), (4, long, "l"), (5, long + " more", "l"), (2, "other text of two", "q"), (6, "\n\n \n", "w")]
    return spark.createDataFrame([(i, t, s, s, s) for i, t, s in rows], "doc_id long, text string, n_words string, key string, kept string")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_same_as_sql(spark, duck, name):
    same(Q.QUERIES[name](spark, DATA), duck, Q.ORACLES[name])


# 1


def spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark, docs):
    extra = ["", "é secret=token: abcdefgh token=token=abcdefgh", 'PASSWORD: "x" api_key = \'abcdef\'', "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12, "0" * 24 + "g" + "f" * 23, "password:abcdef" * 20]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 10_000)), "doc_id long, text string"))
    text = {r.doc_id: r.text for r in table.collect()}
    for r in scan(table).collect():
        base = [tuple(x[:4]) for x in r.found if x.kind < 3]
        assert base == [tuple(x) for x in spans(text[r.doc_id])] and r.n_assign == sum(x[1] == 0 for x in base)


def test_weak_parts_need_each_other(spark, odd, none):
    key = "Zm9vYmFyMTIzNDU2Nzg5MA"
    rows = [(1, f"user: bob1 then {key}"), (2, f"{key} alone"), (3, "login=alice and then " + "x" * 300 + f" {key}"), (4, "see https://a.b/c only"), (5, f"postgres://db.local/x {key}"), (None, f"user=bob {key}")]
    got = [(r.doc_id, [x.name for x in r.found]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, ["identifier", "opaque"]), (2, []), (3, []), (4, []), (5, ["endpoint", "opaque"]), (None, ["identifier", "opaque"])], key=str)
    assert scan(odd).count() == odd.count() and scan(none).count() == 0


def brute_links(t, scope=200):
    """All findings of a text with their partners, by comparing each with each."""
    every = []
    for i, kind in enumerate(KINDS):
        pattern, group, least = PATTERNS[kind]
        for m in re.finditer(pattern, t, re.A):
            v = m[group]
            if len(v) >= least and (kind != "opaque" or re.search("[0-9]", v) and re.search("[A-Za-z]", v)):
                every.append((m.start(), i, m.end(), kind))
    base = [x for x in every if x[1] < 3]
    every = [x for x in every if x[1] < 3 or not any(b[0] < x[2] and x[0] < b[2] for b in base)]
    out = []
    for x in sorted(every):
        parts = [y for y in every if y[3] in COMPLETE[x[3]] and y != x]
        left = max(((y[2], y[0], y[1], y[3]) for y in parts if y[:3] < x[:3]), default=None)
        right = min(((y[0], y[2], y[1], y[3]) for y in parts if y[:3] > x[:3]), default=None)
        a, b = left and x[0] - left[0], right and right[0] - x[2]
        if left and a < scope and (not right or a <= b):
            out.append((*x, (left[3], left[1], left[0])))
        elif right and b < scope:
            out.append((*x, (right[3], right[0], right[1])))
        elif x[1] < 3:
            out.append((*x, None))
    return out


def test_links_against_each_with_each(spark):
    rng = random.Random(4)
    pieces = ["user=bob77", "login: alice", "AKIA" + "Q7" * 9, "token=abcdef12", "https://db.example/x", "Zm9vYmFyMTIzNDU2Nzg5MA", "0123456789abcdef01234567", "word " * 12, "and", "\n"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randrange(25)))) for i in range(150)]
    got = {r.doc_id: [(*x[:4], x.partner and tuple(x.partner)) for x in r.found] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_links(t) for i, t in rows}


def test_many_findings_in_one_text(spark):
    row = scan(spark.createDataFrame([(1, "token=abcdef12 user=bob " * 30_000)], "doc_id long, text string")).selectExpr("n_assign", "size(found) as n", "size(filter(found, x -> x.partner is null)) as alone").first()
    assert (row.n_assign, row.n, row.alone) == (30_000, 60_000, 0)


# 2


class Plain(HTMLParser):
    """Well-formed pages by the standard library's parser: (path, prior facts, text) of each text, and children."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.texts, self.shown = [], [], defaultdict(list)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        words = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower()
        name = tag + "".join(("#" if k == "id" else ".") + re.sub(r"\d+", "9", v) for k, v in attrs if k in ("class", "id"))
        up = self.stack[-1] if self.stack else ("", False, False, False, False)
        aside = tag in ASIDES or tag == "header" and not up[3] or bool(set(re.findall("[a-z]+", words)) & (ASIDE_WORDS - (OUTSIDE_ONLY if up[3] else set())))
        branch = aside or tag in BLOCKS
        under = up[2] or aside
        if up[0] and not up[4]:
            self.shown[up[0]].append(name if branch else tag)
        if tag in VOID:
            return
        self.stack.append((f"{up[0]}/{name}" if branch else up[0], aside, under, (up[3] or tag in ("article", "main")) and not under, up[4] or tag in ("script", "style", "head", "title"), tag, branch))

    def handle_endtag(self, tag):
        while self.stack and self.stack.pop()[5] != tag:
            pass

    def handle_data(self, text):
        if self.stack and not self.stack[-1][4] and text.strip():
            self.texts.append((list(self.stack), " ".join(text.split())))


class BruteTree:
    """One host's tree from whole pages, each with each: nodes are lists of names, features sentences."""

    def __init__(self, pages):
        self.on = defaultdict(dict)  # node -> page -> (prior, share, children of the parent, sentences)
        for k, page in enumerate(sorted(set(pages))):
            p = Plain(page)
            article = any(s[-1][3] for s, _ in p.texts)
            total = sum(len(t) for _, t in p.texts)
            aside = lambda s: next((x[0] for x in reversed(s) if x[1]), None)
            for stack, t in p.texts:
                main, under = stack[-1][3], stack[-1][2]
                node = stack[-1][0] + ("/" + BESIDE if article and not main else "")
                same = [(s, u) for s, u in p.texts if (aside(s) == aside(stack) if aside(stack) else s[-1][0] == stack[-1][0])]
                prior = 1.0 if main else 0.0 if article or under else 0.75
                up = stack[-1][0].rsplit("/", 1)[0]
                _, _, _, sentences = self.on[node].setdefault(k, (prior, sum(len(u) for _, u in same) / total, tuple(p.shown[up]), set()))
                sentences.update(re.split(r"(?<=[.!?])\s+|\s[\u00b7|]\s", t))

    def content(self, node):
        """The sum of one less the entropy of each feature where it stands, and how many there are."""
        on, m = self.on[node], len(self.on[node])
        pages = lambda x: sum(x in o[3] for o in on.values())
        every = [1.0 if m == 1 else 1 - math.log(pages(x)) / math.log(m) for o in on.values() for x in o[3]]
        return sum(every), len(every)

    def evidence(self, node):
        on, m = self.on[node], len(self.on[node])
        up = lambda n: n.removesuffix("/" + BESIDE).rsplit("/", 1)[0]
        family = [self.content(n) for n in self.on if up(n) == up(node)]
        styles = Counter(o[2] for o in on.values())
        style = 1.0 if m == 1 else -sum(n / m * math.log(n / m) for n in styles.values()) / math.log(m)
        own = self.content(node)
        return 0.1 * style + 0.9 * (own[0] / own[1] + sum(a for a, _ in family) / sum(b for _, b in family)) / 2

    def importance(self, node, prior=True):
        on, m, e = self.on[node], len(self.on[node]), self.evidence(node)
        e = e / (2 * LEVEL) if e < LEVEL else min(1, 0.5 + (e - LEVEL) / (2 * (FULL - LEVEL)))
        p, s = sum(o[0] for o in on.values()) / m, sum(o[1] for o in on.values()) / m
        w = 8 + m * (4 * (2 * p - 1) * s if p >= 0.5 else 2 * (1 - 2 * p) * (1 - s))
        return (w * p + m * e) / (w + m) if prior else e

    def text(self, page, low):
        p = Plain(page)
        article = any(s[-1][3] for s, _ in p.texts)
        return "\n\n".join(t for stack, t in p.texts if stack[-1][0] + ("/" + BESIDE if article and not stack[-1][3] else "") not in low)


def node_id(host, path):
    at = step(0, host)
    for name in path.split("/")[1:]:
        at = step(at, name)
    return at


def host_pages(rng, n):
    """Pages of one host: each text in a block of its own, so that blocks are texts."""
    pool = [" ".join(rng.choice("red green blue fish bird tree".split()) for _ in range(5)) for _ in range(7)]
    own = lambda k: " ".join(str(rng.random())[2:9] for _ in range(k))
    kind = rng.randrange(4)
    pages = []
    for i in range(n):
        head = f"<head><title>T{i}</title><script>x</script></head>"
        ps = "".join(f"<p>{own(12)}</p>" for _ in range(rng.randint(1, 4)))
        nav, ad, foot = f"<nav><ul><li>{pool[i % 5]}</li><li>Home</li></ul></nav>", f'<div class="ad">{rng.choice(pool)}</div>', f"<footer>Imprint {i % 2}</footer>"
        if kind == 0:
            body = f"{nav}{ad}<article><h1>{own(2)}</h1>{ps}<div class=x9>Share this page</div></article><div>{rng.choice(pool)}</div>{foot}"
        elif kind == 1:  # no article; what all pages share has no name
            body = f"<div class=top>Welcome to the site</div><div class=body>{ps}</div><div class=end>Bye</div>{foot}"
        elif kind == 2:  # an aside in name only
            body = f'<div class="with sidebar layout">{nav}<h1>{own(2)}</h1>{ps}</div>{foot}'
        else:  # comments differ on each page
            body = f"<article><h1>{own(2)}</h1>{ps}</article><section class=comments><p>{own(6)}</p></section>{ad}"
        pages.append(f"<html>{head}<body>{body}</body></html>")
    return kind, pages


def test_pages_against_a_brute_force_tree(spark):
    rng = random.Random(11)
    hosts = [host_pages(rng, n) for n in (1, 2, 3, 6, 12, 30, 30, 30, 30, 60, 60, 60)]
    rows = [(100 * h + i, f"http://h{h}.example/{i}", page) for h, (_, pages) in enumerate(hosts) for i, page in enumerate(pages)]
    rows += [(9000 + i, u, page) for i, u, page in rows[::7]]  # copies count once
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    trees = {f"h{h}.example": BruteTree(pages) for h, (_, pages) in enumerate(hosts)}
    for prior in (False, True):
        by = {node_id(h, x): t.importance(x, prior) for h, t in trees.items() for x in t.on}
        got = {r.node: r.importance for r in style_tree(df, prior=prior).collect()}
        assert got == pytest.approx(by)
        low = {h: {x for x in t.on if by[node_id(h, x)] < 0.5} for h, t in trees.items()}
        want = {i: trees[u.split("/")[2]].text(page, low[u.split("/")[2]]) for i, u, page in rows}
        for options in ({}, {"broadcast_bytes": 0}):
            assert {r.page_id: r.text for r in extract_pages(df, prior=prior, **options).collect()} == want
    for h, (kind, pages) in enumerate(hosts):
        if len(pages) >= 30:
            shown = want[100 * h]
            assert "Imprint" not in shown and "Home" not in shown and "Share" not in shown and "Welcome" not in shown and "Bye" not in shown
            assert len(shown.split("\n\n")) == pages[0].count("<p>") - (kind == 3) + (kind != 1)


def article_text(html):
    """The text of a page of the test tables, which have one plain article each."""
    parts = re.split(r"</?(?:p|h1|article)>", re.search(r"<article>(.*)</article>", html, re.S)[1])
    return "\n\n".join(t for t in (" ".join(htmllib.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts) if t)


def test_the_tree_decides(spark):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    tree = style_tree(df).collect()
    low, every = {r.node for r in tree if r.importance < 0.5}, {r.node for r in tree}
    for r in df.collect():
        host = r.url.split("/")[2].lower()
        text = extract(r.html, low, host)
        assert extract(r.html) != text and extract(r.html, every, host) == "" != text and text == article_text(r.html)


def test_entropies_alone_find_the_article(spark):
    """No name or element is known here: classes are letters, and the prior is off."""
    rng = random.Random(8)
    own = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    pool = [own(8) + "." for _ in range(30)]
    pages = [f"<body><div class=q><span>{rng.choice(pool)}</span></div><div class=r><h1>{(t := own(3))}</h1><p>{own(20)}. {own(9)}.</p></div><div class=s>{rng.choice(pool)}</div></body>" for _ in range(120)]
    want = {i: "\n\n".join(re.findall(r"<(?:h1|p)>(.*?)</", p)) for i, p in enumerate(pages)}
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_pages(df, prior=False).collect()} == want
    assert {r.page_id: r.text for r in extract_pages(df).collect()} == want  # unnamed text is left to the evidence


def test_deep_and_long_pages(spark):
    n = 100_000
    pages = ["<div>x" * n, "<article><p>" + "<b>" * n + "y" + "<hr></i></p>" * 1000, "<td>" + "<i>" * n + "<hr><li>z" * 1000, "<article><p>" + "word " * 400_000 + "</article>"]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    began = time.time()
    got = {r.page_id: r.text for r in extract_pages(df).collect()}
    assert time.time() - began < 120  # the square of the nesting would take hours
    assert got[0] == "\n\n".join("x" * n) and got[1] == "y" and got[2] == "\n\n".join("z" * 1000) and got[3] == ("word " * 400_000).strip()


def test_html_pages():
    page = '<html><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><div class="content"><div class="sidebar-left">Side</div><h2>Ti&amp;tle</h2>Hello <b>w</b>orld<br>x <ul><li>a<li>b</ul><div class="comments"><p>nice</p></div></div><script>if(a<b){"</div>"}</script><form>q</form><footer>f</footer>'
    low = lambda p: {k for k, x in nodes_of(p).items() if x.prior == 0}  # noqa: E731 - all that a single page gives
    assert extract(page, low(page)) == "Ti&tle\n\nHello world x\n\na\n\nb"
    page = '<body><nav>n</nav><article class="post"><header><h1>T</h1></header><p>One &lt;b&gt; two&nbsp;  three<aside>no</aside><section class="comments"><p>c</p></section><p>four<div class="ad">buy</div></article><article class="comment">x</article><p>out'
    assert extract(page, low(page)) == "T\n\nOne <b> two three\n\nfour"
    assert extract(None) == extract("") == "" and extract("a < b > c") == "a < b > c" and extract("<p>x<!-- no") == "x"


def test_style_tree_drops_what_pages_share(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class=top>Same words on all</div><div class=main><p>Text {i} of its own, and more of it</div></body>") for i in range(12)]
    pages += [(100, "http://other.example/", "<body><div class=top>Same words on all</div><p>once</body>"), (101, None, None), (102, "x", ""), (101, None, None), (100, "http://other.example/", "<body><div class=top>Same words on all</div><p>once</body>")]
    df = spark.createDataFrame([(*p, "clash", "clash", 1) for p in pages], "page_id long, url string, html string, text string, host string, low int")
    tree = {r.node: r for r in style_tree(df).collect()}
    top, main = tree[node_id("h.example", "/body/div.top")], tree[node_id("h.example", "/body/div.main/p")]
    assert top.style == pytest.approx(0) == top.content and top.importance < 0.5 and main.content == 1 and main.importance > 0.5
    for options in ({}, {"broadcast_bytes": 0}):
        got = [(r.page_id, r.text) for r in extract_pages(df, **options).collect()]
        assert len(got) == len(pages)
        by = dict(got)
        assert by[3] == "Text 3 of its own, and more of it" and by[100] == "Same words on all\n\nonce" and by[101] == by[102] == ""
    assert extract_pages(df.limit(0)).count() == 0


# 3 and 5


@pytest.fixture(scope="module")
def ids(docs, odd):
    from corpusql.llm.encoder import Encoder

    whole = Encoder(Q.vocabulary(), 1).whole
    return lambda t: np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], np.uint32)


def test_token_files(docs, odd, none, ids):
    for table in (docs, odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in table.collect()))
        at, want = 0, []
        for known, d, t in rows:
            x = ids(t)
            want.append((d if known else None, at, len(x), zlib.crc32(x.astype("<u4").tobytes())))
            at += len(x)
        got = sorted(token_table(table, Q.vocabulary(), end=1, file_tokens_bytes=100_000).collect(), key=lambda r: r.start)
        assert [(r.n_tokens, r.ids_crc32, r.start) for r in got] == [(w[2], w[3], w[1]) for w in want] and [r.doc_id for r in got] == [w[0] for w in want]
    assert token_table(none, Q.vocabulary(), end=1).count() == 0


def test_only_wanted_frames_are_read(docs, ids, tmp_path, monkeypatch):
    from corpusql.llm import token_files as tf

    at = f"file://{tmp_path}"
    files = tf.write_token_files(docs, at, Q.vocabulary(), end=1, partitions=1)
    text = {r.doc_id: r.text for r in docs.collect()}
    wanted = {3, 57, 111}
    got = {r.doc_id: list(r.tokens) for r in tf.read_token_files(files, at, wanted=wanted, with_tokens=True).collect()}
    assert got == {d: ids(text[d]).tolist() for d in wanted}
    # In one file: how many frames are decompressed for one document in the middle of it.
    (name,) = [r.file for r in files.collect()]
    raw = (tmp_path / name).read_bytes()
    reader, opened = tf.Reader(io.BytesIO(raw), len(raw)), []
    whole = reader.frame
    monkeypatch.setattr(reader, "frame", lambda k: opened.append(k) or whole(k))
    place = reader.doc_ids.tolist().index(57)
    assert reader.tokens(place).tolist() == ids(text[57]).tolist() and len(set(opened)) == 1 and len(reader.frames) > 1


def test_packing(docs, odd, none, ids):
    out = pack_documents(docs, Q.vocabulary(), end=1, group_docs=64)
    text = {r.doc_id: ids(r.text) for r in docs.collect()}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in out.collect():
        assert r.ids_crc32 == zlib.crc32(text[r.doc_id][r.start : r.start + r.length].astype("<u4").tobytes()) and r.doc_tokens == len(text[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts, total in [*((pieces[d], len(text[d])) for d in text), *((p, None) for p in seqs.values())]:
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == total if total is not None else at <= 2048
    p = padding(out).first()
    assert p.padding < 0.03 * p.ids
    assert pack_documents(odd, Q.vocabulary(), end=1).count() >= odd.count() and pack_documents(none, Q.vocabulary()).count() == 0


# 4


def test_prefix_code():
    for counts in ([5, 1, 1, 9, 2, 0], [1], list(range(1, 3000)), [10**9] + [1] * 500):
        codes, lengths = prefix_code(np.array(counts))
        words = sorted(format(int(c), f"0{n}b") for c, n in zip(codes, lengths))
        assert not any(b.startswith(a) for a, b in zip(words, words[1:])) and lengths[int(np.argmax(counts))] == min(lengths)
    share = np.array(counts) / sum(counts)
    assert (lengths <= np.ceil(-np.log2(share))).all()


MASK = (1 << 64) - 1


def mix_one(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 33


class PlainMixer:
    """The model bit by bit in plain Python: no blocks, no slots, no hashing of codes."""

    def __init__(self, train, settings):
        self.s = settings
        self.hash = {}
        for t in train:
            self.note(t)
        counts = Counter(w for t in train for w in self.words(t))
        vocabulary = {w: n for w, n in counts.items() if n >= settings.least}
        order = sorted(vocabulary, key=lambda w: self.hash[w])
        rare = sum(counts.values()) - sum(vocabulary.values())
        by_byte = Counter(x for w, n in counts.items() for x in list(w.encode()) * n)
        codes, lengths = prefix_code(np.array([rare + 1, len(train) + 1, *(vocabulary[w] for w in order)]))
        code = lambda i: format(int(codes[i]), f"0{lengths[i]}b")
        self.code = {w: code(i + 2) for i, w in enumerate(order)} | {0: code(0), 1: code(1)}
        self.number = {w: i + 2 for i, w in enumerate(order)} | {0: 0, 1: 1}
        codes, lengths = prefix_code(np.array([*(by_byte[i] for i in range(255)), sum(by_byte.values()) // 6 + 1]))
        self.code |= {("byte", i): code(i) for i in range(256)}
        self.number |= {("byte", i): len(order) + 2 + i for i in range(256)}
        first = sorted(range(len(order)), key=lambda i: (-vocabulary[order[i]], i))[: settings.anchors]
        self.anchors = {order[i] for i in first}
        self.follows = [defaultdict(Counter) for _ in range(3)]
        for t in train:
            for symbol, ctx, _ in self.symbols(t):
                for c in range(3):
                    self.follows[c][ctx[c]][symbol] += 1

    def words(self, t):
        return re.findall(SPACED, low(t))

    def note(self, t):
        for b in blocks(pa.array([t])):
            w = b.words(SPACED_LOWER)
            self.hash |= dict(zip(self.words(t), w.hash.tolist()))

    def symbols(self, t):
        """(symbol, contexts, word number) of a text."""
        self.note(t)
        anchor = last = before = 0
        ws = self.words(t)
        for i, w in enumerate([*ws, None]):
            symbol = 1 if w is None else w if w in self.code else 0
            yield symbol, self.keys(anchor, last, last + mix_one(before)), i
            if symbol == 0:
                seen = [0] * 5
                for x in [*w.encode(), 255]:
                    # a context of d bytes: the last in the lowest 9 bits
                    held = [sum(v << 9 * j for j, v in enumerate(seen[:d])) + (1 << 50) for d in (1, 3, 5)]
                    yield ("byte", x), self.keys(*held), i
                    seen = [x + 1, *seen[:4]]
            if w is not None:
                before, last = last, self.hash[w]
                anchor = last if w in self.anchors else anchor

    def keys(self, *ctx):
        return [mix_one((x + c + 1) & MASK) >> 24 for c, x in enumerate(ctx)]

    def predictions(self, symbol, ctx):
        """For each bit of a symbol the three predictions and the bit."""
        code, guess = self.code[symbol], None
        if f := self.follows[2][ctx[2]]:
            guess, n = min(f.items(), key=lambda x: (-x[1], self.number[x[0]]))
            odds = round(14 * math.log((n + 0.3) / (f.total() - n + 0.3)))
        for i, bit in enumerate(code):
            out = []
            for c in range(2):
                after = Counter()
                for other, n in self.follows[c][ctx[c]].items():
                    if len(self.code[other]) > i and self.code[other].startswith(code[:i]):
                        after[self.code[other][i]] += n
                out.append(round(14 * math.log((after["1"] + 0.4) / (after["0"] + 0.4))))
            agrees = guess is not None and self.code[guess].startswith(code[:i]) and len(self.code[guess]) > i
            out.append((odds if self.code[guess][i] == "1" else -odds) if agrees else 0)
            yield [max(-126, min(126, x)) for x in out], int(bit)

    def score(self, t):
        s, total = self.s, 0.0
        weights = defaultdict(lambda: list(s.start))
        refined = defaultdict(lambda: None)
        turn = lambda i: sum(i >= e for e in (1, 2, 4, 8, 12, 16)) + max(i - 16, 0) // s.step
        steps = defaultdict(list)
        for symbol, ctx, i in self.symbols(t):
            steps[turn(i)] += [(x, y, isinstance(symbol, tuple)) for x, y in self.predictions(symbol, ctx)]
        for k in sorted(steps):
            change, off, times = defaultdict(lambda: [0.0] * 3), Counter(), Counter()
            for x, y, is_byte in steps[k]:
                a, b = abs(x[1]) / 14, abs(x[2]) / 14
                gate = 16 * is_byte + 8 * (a > 0.5) + 4 * (a > 2) + 2 * (b > 0.5) + (b > 1.8)
                z = [v / 14 for v in x]
                dot = max(-7.99, min(7.99, sum(w * v for w, v in zip(weights[gate], z))))
                cell = gate >> 2, int((dot + 8) * 24 / 16)
                p = 1 / (1 + math.exp(-dot))
                q = refined[cell] if refined[cell] is not None else 1 / (1 + math.exp(8 - (cell[1] + 0.5) * 16 / 24))
                refined[cell] = q
                one = (p + q) / 2
                total += math.log(min(max(one if y else 1 - one, 1e-5), 1 - 1e-5))
                for c in range(3):
                    change[gate][c] += (y - p) * z[c]
                off[cell] += y - q
                times[cell] += 1
            for gate, d in change.items():
                weights[gate] = [w + s.rate * v for w, v in zip(weights[gate], d)]
            for cell, n in times.items():
                refined[cell] += off[cell] / (n + s.map_inertia)
        return total / math.log(10)


def test_lm_scores_bit_by_bit(spark):
    rng = random.Random(2)
    words = "the of and sea ship sails Tide moon é漢 harbour oars q zz".split()
    texts = [" ".join(rng.choice(words[: rng.randint(3, len(words))]) + rng.choice(["", "", "", "s", f"{rng.randint(0, 99)}"]) for _ in range(rng.choice([0, 1, 5, 30, 90]))) for _ in range(40)]
    s = Settings(fit_bytes=0, slots=1 << 14, run_slots=1 << 12, anchors=3, table_bytes=1 << 50, step=8)
    rows = list(enumerate(texts))
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    plain = PlainMixer([t for d, t in rows if not held(d)], s)
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), settings=s).collect()}
    assert got == {d: pytest.approx(plain.score(t), rel=2e-4, abs=1e-3) for d, t in rows}


def test_lm_scores(docs, odd, none):
    rows = docs.collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: re.findall(SPACED, low(t)) + ["\n"]
    c = Counter(w for r in rows if not held(r.doc_id) for w in words(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    for r in rows:
        g, w = got[r.doc_id], words(r.text)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and g.score < 0
    again = {r.doc_id: r.score for r in score_documents(docs.repartition(3)).collect()}
    assert all(again[d] == pytest.approx(got[d].score, rel=1e-6) for d in got)
    assert score_documents(odd).count() == odd.count() and score_documents(none).count() == 0


def test_lm_fits_on_all_texts(spark):
    import xxhash

    from corpusql.llm.lm_score import fit, fitted

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    # Each longer than any sample of short texts would take; one comes several times.
    texts = [" ".join(rng.choices(words, range(300, 0, -1), k=16_000)) for _ in range(5)]
    train = spark.createDataFrame([(t,) for t in texts + texts[:1] * 3], "t string")
    counted = training_counts(train).cache()
    settings = Settings()
    path, _, _ = vocabulary(counted.where("kind = 0").select("key", "n"), settings)
    by_byte = [0] * 256
    for r in counted.where("kind = 1").collect():
        by_byte[r.key] = r.n
    where = Where(path, 0, 8, tuple(by_byte), settings)
    got = fitted(train, where)
    # One group: what reading it teaches, for all that it has met.
    model = model_of(where)
    fit(model, sorted(texts, key=lambda t: (xxhash.xxh64_intdigest(t), t)))
    met = model.met[0] > 0
    mine = np.frombuffer(got.weights, np.float32).reshape(model.weights.shape)
    assert met.sum() > 3 and np.allclose(mine[:, met], np.clip(model.weights, 0, 1.5)[:, met], atol=1e-3)
    assert np.allclose(mine[:, ~met], np.array(settings.start, np.float32)[:, None])
    # Several groups: the same in whatever order and parts the texts come.
    where = Where(path, 0, 8, tuple(by_byte), Settings(fit_bytes=1 << 17))
    a, b = fitted(train, where), fitted(train.orderBy("t").repartition(7), where)
    assert a.weights == b.weights and a.refined == b.refined and a.weights != got.weights


def test_lm_finds_words_of_a_large_vocabulary():
    from corpusql.llm.lm_score import Model

    rng = np.random.default_rng(6)
    hashes = np.unique(rng.integers(0, 1 << 64, 700_000, dtype=np.uint64))
    model = Model(hashes, np.full(len(hashes), 2), 1, 1, np.ones(256, np.int64), Settings())
    # However many words there are, few share the bits by which they are found.
    assert np.diff(model.start).max() <= 10 and (model.find(hashes) == np.arange(len(hashes))).all()
    others = rng.integers(0, 1 << 64, 100_000, dtype=np.uint64)
    assert ((model.find(others) >= 0) == np.isin(others, hashes)).all()


def test_lm_groups_are_read_side_by_side(spark, monkeypatch):
    """Each teaches what it does alone, and together they take the steps of the longest."""
    from corpusql.llm import lm_score

    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [[" ".join(rng.choices(words, range(200, 0, -1), k=300)) for _ in range(k)] for k in (12, 3, 30, 1, 8)]
    counted = training_counts(spark.createDataFrame([(t,) for g in texts for t in g], "t string")).cache()
    settings = Settings()
    path, _, _ = vocabulary(counted.where("kind = 0").select("key", "n"), settings)
    model = model_of(Where(path, 0, 54, (1,) * 256, settings))
    steps, read = [], lm_score.Mind.read
    monkeypatch.setattr(lm_score.Mind, "read", lambda self, raw, bit, key, edges: steps.append(len(edges) - 1) or read(self, raw, bit, key, edges))
    alone, taken = [], []
    for g in texts:
        steps.clear()
        alone += lm_score.fit_groups(model, [g])
        taken.append(sum(steps))
    steps.clear()
    together = lm_score.fit_groups(model, texts)
    assert len(alone) == len(together) == 4 and sum(steps) == max(taken) < sum(taken) / 1.5
    for a, b in zip(alone, together):
        assert all((x == y).all() for x, y in zip(a, b))


def test_lm_tables_grow_and_are_bounded(spark, docs, tmp_path):
    few, all_ = (docs.where(f"doc_id % {k} = 0").select(F.coalesce("text", F.lit("")).alias("t")) for k in (4, 1))

    def tables(train, settings):
        counted = training_counts(train).cache()
        path, _, within = vocabulary(counted.where("kind = 0").select("key", "n"), settings)
        where = write_tables(train, Where(path, 0, 10, (1,) * 256, settings), within)
        m = model_of(where)
        return sum(len(x) for x in m.tables.odds) + 6 * len(m.tables.symbol), len(m.hashes)

    (a, wa), (b, wb) = tables(few, Settings()), tables(all_, Settings())
    assert b > 2 * a and wb > 1.5 * wa
    assert tables(all_, Settings(table_bytes=1 << 18, words=500))[0] < 1 << 18 and tables(all_, Settings(words=500))[1] <= 500


# 6


def test_quality_rows(odd, none):
    out = quality_rules(odd)
    assert out.count() == odd.count() and dict(out.dtypes)["n_words"] == "bigint" and "key" in out.columns
    assert quality_rules(none).count() == 0


# 7


def test_decontamination(spark, docs, odd, none):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    more = spark.createDataFrame([(900, "d e f"), (901, ""), (902, None), (903, "word1 word2"), (None, "null id null id"), (900, "d e f")], "item_id long, text string")
    bench = bench.union(more)
    windows = defaultdict(set)
    for r in bench.collect():
        w = re.findall(ALNUM, low(r.text))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add("null" if r.item_id is None else str(r.item_id))
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text"))
    for options in ({}, {"block_bytes": 2000}):
        for r in decontaminate(table, bench, keep=["doc_id", "text"], **options).collect():
            w = re.findall(ALNUM, low(r.text))
            hit, items = set(), set()
            for k in {len(x) for x in windows}:
                for i in range(len(w) - k + 1):
                    if found := windows.get(tuple(w[i : i + k])):
                        hit |= set(range(i, i + k))
                        items |= found
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(items))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    assert decontaminate(odd, bench.limit(0)).where("contaminated").count() == 0 and decontaminate(none, bench).count() == 0


# 8


def brute_near(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(SPACED, low(t))
        sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in sets}


def test_near_duplicates(spark, docs, odd, none):
    base = [f"w{i}" for i in range(80)]
    near = [(1000 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 80, 3)] + [(2000, "few words"), (2001, "FEW words"), (2002, "")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    want = brute_near([(r.doc_id, r.text) for r in table.collect()])
    got = {r.doc_id: r for r in near_duplicates(table).collect()}
    assert {d: r.component_id for d, r in got.items()} == want and all(r.kept == (r.component_id == d) for d, r in got.items())
    assert {d: r.component_id for d, r in ((r.doc_id, r) for r in near_duplicates(table, broadcast_bytes=0).collect())} == want
    o = near_duplicates(odd).collect()
    assert len(o) == odd.count() and {r.component_id for r in o if r.doc_id in (4, 5)} == {4} and near_duplicates(none).count() == 0


def test_near_duplicates_inside_crowds(spark):
    """Half-alike texts that share large buckets: pairs with rare shingles in common, and pairs without any."""
    rng = np.random.default_rng(5)
    base, rows = " ".join(f"base{i}" for i in range(87)), []
    for p in range(600):  # 86 of 114 shingles in common with the partner, 83 of 117 with the others
        rows += [(2 * p + j, " ".join([base, *(f"p{p}w{i}" for i in range(3)), *(f"p{p}t{j}w{i}" for i in range(14))])) for j in range(2)]
    base, blocks = " ".join(f"other{i}" for i in range(60)), [" ".join(f"b{b}w{i}" for i in range(9)) for b in range(12)]
    rows += [(5000 + t, " ".join([base, *(blocks[b] for b in sorted(rng.choice(12, 5, replace=False)))])) for t in range(120)]
    want = brute_near(rows)
    table = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(table).collect()} == want
    assert {r.doc_id: r.component_id for r in near_duplicates(table, neighbours=1, few=4).collect()} == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100


# 9


def test_archives(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a/1", big), (2, "http://a/2 x\r\ny", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", None), (None, "n", big), (2, "http://a/2 x\r\ny", big), (6, "v", "<p>one\r\n\r\ntwo" + "z" * 2000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    for options in ({}, {"broadcast_bytes": 0, "file_bytes": 1}):
        got = archive_table(df, **options).collect()
        assert len(got) == len(rows)
        kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
        assert kinds[1, "revisit", 2] == 1 and kinds[None, "revisit", 2] == 1 and kinds[2, "response", None] == 2 and kinds[3, "response", None] == kinds[4, "response", None] == 1
        assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}
    assert archive_table(df.limit(0)).count() == 0 and build_dictionary([]) == b""


def test_record_ids(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "u", "y"), (3, "u", "y"), (5, "v", "z" * 1200), (5, "v", "z" * 1200), (4, "w", "z" * 1200)]
    at = f"file://{tmp_path}"
    files = write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), at).collect()
    heads = [h for r in files for h, _ in parse_archive((tmp_path / r.file).open("rb"))]
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(rows)
    by = {(h["x-page-id"], h["warc-type"]): h for h in heads}
    one = by["1", "revisit"]
    assert one["warc-refers-to"] == by["2", "response"]["warc-record-id"] and one["warc-refers-to-target-uri"] == "http://a/2"
    assert "warc-refers-to" not in by["4", "revisit"] and by["4", "revisit"]["x-refers-to-page-id"] == "5"


# 10


def test_line_dedup(spark, odd, none):
    rows = [(1, "a\nb\nc\nd", "p"), (1, "a\nb\nc\nd", "p"), (2, "x\na \n b\nc", "q"), (None, None, None), (3, "", "z"), (4, "\n\n\n\n", "z"), (5, "b\nc\nd\ne\nb\nc\nd", "k"), (6, "a\nb", "k"), (7, " a\nb", "k"), (8, "a", "k"), (9, "a", "m"), (None, None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, k string, lines string")
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed, r.k, r.lines) for r in line_dedup(df).collect()), key=str)
    want = [(0, None, 0, 0, None), (1, "", 4, 4, "p"), (1, "a\nb\nc\nd", 4, 0, "p"), (2, "x", 4, 3, "q"), (3, "", 1, 0, "z"), (4, "\n\n\n\n", 5, 0, "z"), (5, "e", 7, 6, "k"), (6, "a\nb", 2, 0, "k"), (7, "", 2, 2, "k"), (8, "a", 1, 0, "k"), (9, "", 1, 1, "m"), (0, None, 0, 0, None)]
    assert got == sorted(((*w, "clash") for w in want), key=str)
    assert line_dedup(odd).count() == odd.count() and line_dedup(none).count() == 0
