"""The text operators against brute force on small fixtures, with odd rows."""

import collections
import hashlib
import json
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tickforge.llm import (common, cutting_stock, hash_tree, host_quality, line_spread, multi_index, oph_dedup,
                           page_wrapper, secret_scan, url_aliases, word_bpe)

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice(["th", "er", "on", "an", "in", "re", "ß", "é"]) for _ in range(rng.randint(1, 4)))
            for _ in range(400)]


def odd_texts():
    return [None, "", "   ", "\n\n", "one", "one two", "ONE two", "a b c d e f g h i j", "x " * 3000, "\x1c a\x85b\xa0c",
            "<|endoftext|> ab<|startoftext|>", "日本 語", "Σας ΑΣ don't", "same line\nsame line\nother", "a" * 5000]


@pytest.fixture(scope="module")
def docs(spark):
    """Random, near and exact copies, repeated rows, and odd texts; one source has a third."""
    rng, words = random.Random(1), vocabulary()
    rows = []
    for t in odd_texts():
        rows.append(t)
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 120]))]
        rows.append(" ".join(base))
        if rng.random() < 0.6:
            for _ in range(rng.randint(1, 4)):
                copy = list(base)
                for _ in range(rng.randint(0, 1 + len(copy) // 15)):
                    copy[rng.randrange(len(copy))] = rng.choice(words)
                rows.append(" ".join(copy))
    data = [(i, t, "en", "hot" if i % 3 == 0 else f"s{i % 7}", None if t is None else len(t)) for i, t in enumerate(rows)]
    data += [data[20], (None, "null key text here", None, None, 5), (None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS).repartition(3).cache()


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- 1 sharding

def shard_brute(key, leaves):
    def u(node):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42) if key is not None else 42
        return (xxhash.xxh64_intdigest(node.encode(), seed=h) >> 11) + 0.5

    def descend(below, names, path):
        if not names:
            return below[0].shard
        kids = {}
        for x in below:
            kids.setdefault(names[0](x), []).append(x)
        if len(kids) == 1:
            c, v = next(iter(kids.items()))
            return descend(v, names[1:], f"{path}/{c}")
        c = min(kids, key=lambda c: -math.log(u(f"{path}/{c}") / 2 ** 53) / sum(x.weight for x in kids[c]))
        return descend(kids[c], names[1:], f"{path}/{c}")
    return descend(leaves, (lambda x: x.region, lambda x: x.rack, lambda x: str(x.shard)), "")


def test_hash_tree(spark, docs):
    got = rows_of(hash_tree.place(docs.withColumn("_rid", F.lit(1)).withColumn("SHARD_", F.lit(2))))
    texts = collections.Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert len(got) == sum(texts.values())
    want = collections.Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts.elements())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for r in got:
        assert r["shard"] == shard_brute(r["doc_id"], hash_tree.tree(8))
        assert r["grown_shard"] == shard_brute(r["doc_id"], hash_tree.tree(9)) and r["grown_shard"] in (r["shard"], 8)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert hash_tree.place(empty(spark)).count() == 0


def test_hash_tree_weights(spark):
    """Movement stays inside subtrees whose weights change; shares follow weights."""
    keys = spark.range(4000)
    old = [hash_tree.Leaf("a", "r", 0), hash_tree.Leaf("a", "s", 1, 2.0), hash_tree.Leaf("b", "t", 2), hash_tree.Leaf("b", "t", 3)]
    new = [*old[:3], hash_tree.Leaf("b", "t", 3, 2.0)]
    got = keys.select(hash_tree.shard_of(F.col("id"), old).alias("o"), hash_tree.shard_of(F.col("id"), new).alias("n")).collect()
    count = collections.Counter(r.o for r in got)
    assert all(abs(count[s] / 4000 - w / 5) < 0.03 for s, w in enumerate([1, 2, 1, 1]))
    assert all(r.n in (2, 3) for r in got if r.o != r.n)
    with pytest.raises(ValueError):
        hash_tree.shard_of(F.col("id"), [hash_tree.Leaf("a", "r", 0), hash_tree.Leaf("a", "r", 0)])


@pytest.mark.parametrize("base", [1, 3, 8])
def test_a_new_shard_takes_rows_only_into_itself(spark, base):
    """One tree at every count from its base on: what count n calls grown is what count n + 1 gives."""
    ids = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = None
    for n in (base, base + 1, base + 2):
        rows = hash_tree.place(ids, n_shards=n, base=base).collect()
        at, grown = ({r.doc_id: r[c] for r in rows} for c in ("shard", "grown_shard"))
        assert set(at.values()) == set(range(n)) and all(grown[i] in (at[i], n) for i in at) and n in grown.values()
        assert before is None or at == before
        before = grown
    with pytest.raises(ValueError):
        hash_tree.tree(base - 1, base)


def test_gapless_rank_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "RANK_BUCKET_BITS", 2)
    df = common.staged(spark.range(0, 200, 1, 5).select((F.col("id") % 10 > 2).alias("k"),
                                                        F.monotonically_increasing_id().alias("rid")), "hot")
    ranks = collections.defaultdict(list)
    for r in common.gapless_rank(df, ["k"], "rid", "rank").collect():
        ranks[r.k].append((r.rid, r["rank"]))
    assert all([x for _, x in sorted(v)] == list(range(len(v))) for v in ranks.values())


# --- 2 quality rules

def measure_brute(text):
    words = WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i:i + 5])].append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_host_quality(spark, docs):
    extra = spark.createDataFrame(
        [(900 + i, t, "en", "bad" if i < 9 else None, 1) for i, t in enumerate(
            ["a | b | c # d * e $ f % g & h < i > j k l"] * 7 + ["a b c d e f g h i j k l"] * 2 + ["p q r s t"] * 6)], DOCS)
    d = docs.unionByName(extra).withColumn("measures", F.lit(0)).withColumn("Kept", F.lit("x")).withColumn("_host", F.lit(0))
    judged, (m, base, host, kept) = host_quality.judge(d)
    assert judged.columns[:len(d.columns)] == d.columns
    got = rows_of(judged)
    assert len(got) == d.count()
    rates, out = collections.Counter(), collections.defaultdict(list)
    for r in got:
        x = r[m]
        want = measure_brute(r["text"])
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        soft = (want[1] < 2 * want[0] or want[1] > 15 * want[0] or 10 * want[2] > 3 * want[0] or 10 * want[3] > 3 * x["n_lines"])
        assert r[base] == failed
        out[r["source"]].append((failed, soft, r[host], r[kept]))
    n = {s: len(v) for s, v in out.items()}
    bad = {s: sum(f or t for f, t, _, _ in v) for s, v in out.items()}
    rate = [bad[s] / n[s] for s in n]
    alpha, beta = host_quality.beta_prior(float(np.mean(rate)), float(np.var(rate, ddof=1)))
    for s, v in out.items():
        rejected = bad[s] + alpha > 0.5 * (n[s] + alpha + beta)
        for failed, soft, h, k in v:
            assert h == rejected and k == (not failed and not (rejected and soft))
    assert any(h for _, _, h, _ in out["bad"])
    assert host_quality.keep_good(empty(spark)).count() == 0
    assert host_quality.beta_prior(None, None) == (1.0, 1.0) and host_quality.beta_prior(0.0, 0.0)[0] == 0.0


# --- 3 embeddings

def test_multi_index(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", 16)
    monkeypatch.setattr(multi_index, "MEMBERS", 7)
    monkeypatch.setattr(multi_index, "VISITORS", 5)
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for c in range(25):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 14))):
            v = centre + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3, 0.45])
            rows.append((i, [float(x) for x in v], c % 3 if c else None))
            i += 1
    rows += [(i, None, 1), (i + 1, [0.0] * 16, 1), (i + 2, [float("nan")] * 16, 1), (i + 3, [1.0, None], 1), (i + 4, [], 1),
             (i + 5, [1.0, 2.0], 1), (i + 6, [2.0, 4.0], 1), (i + 7, [1e300, 2e300], 1), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("_row", F.lit(1))
    out, (rid, links, component) = multi_index.near_vectors(df)
    got = rows_of(out)
    assert len(got) == len(rows)
    units = multi_index.units([r["embedding"] for r in got])

    def linked(a, b):
        x, y = got[a], got[b]
        return (units[a] is not None and units[b] is not None and x["label"] is not None and x["label"] == y["label"]
                and len(units[a]) == len(units[b]) and float(units[a] @ units[b]) >= 0.93)
    parent = list(range(len(got)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    near = [[b for b in range(len(got)) if a != b and linked(a, b)] for a in range(len(got))]
    for a, v in enumerate(near):
        for b in v:
            parent[find(a)] = find(b)
    found, wanted = sum(r[links] for r in got), sum(map(len, near))
    assert found <= wanted and found >= 0.99 * wanted  # the traversal stops at its target recall
    assert all(r[links] <= len(v) for r, v in zip(got, near))
    if found == wanted:
        names = collections.defaultdict(set)
        for a, r in enumerate(got):
            names[find(a)].add(r[component])
        assert all(len(v) == 1 for v in names.values()) and len(names) == len({r[component] for r in got})
    assert multi_index.near_vectors(empty(spark, "vec_id long, embedding array<float>, label int"))[0].count() == 0


@pytest.mark.parametrize("decay", [0.0, 1.0])
def test_no_near_vector_is_missed_on_a_decaying_spectrum(spark, monkeypatch, decay):
    """Planted pairs just over the threshold, differing most in the leading dimensions."""
    monkeypatch.setattr(multi_index, "CELL", 2)
    rng = np.random.default_rng(7)
    spectrum = np.arange(1, 65.0) ** -decay
    x = rng.normal(size=(600, 64)) * spectrum
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=x.shape) * spectrum
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    y = 0.931 * x + np.sqrt(1 - 0.931 ** 2) * noise
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(np.concatenate([x, y]))]
    out, (_, links, _) = multi_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    both = np.array([r[1] for r in rows])
    both /= np.linalg.norm(both, axis=1)[:, None]
    wanted = (both @ both.T >= 0.93).sum(axis=1) - 1
    assert {r["vec_id"]: r[links] for r in rows_of(out)} == dict(enumerate(wanted.tolist()))


@pytest.mark.parametrize("decay", [0.0, 0.5, 1.0])
def test_the_traversal_prunes_and_reaches_its_recall(spark, monkeypatch, decay):
    """Groups of near vectors at many distances: few cells visited, links against brute force."""
    monkeypatch.setattr(multi_index, "CELL", 64)
    rng = np.random.default_rng(11)
    spectrum = np.arange(1, 33.0) ** -decay
    centres = rng.normal(size=(3000, 32)) * spectrum
    size = np.sqrt((spectrum ** 2).sum())
    x = np.concatenate([centres, *(centres + rng.normal(size=centres.shape) * spectrum * rng.uniform(0, 0.25, (3000, 1))
                                   for _ in range(3))]) / size
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tobytes(), 5) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node long, unit binary, tag long")
    sample = [(x[i], {"node": i, "tag": 5}) for i in range(0, len(x), 3)]
    grid = multi_index.Grid(np.stack([v for v, _ in sample]), math.ceil(math.sqrt(len(x) / multi_index.CELL)))
    radius, recall = multi_index.radii(nodes, sample, {32: grid}, 0.93)[32]
    assert recall == 1.0
    own, low_a, low_b = grid.place(x)
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    need = grid.needed([v[a] for v in (own, low_a, low_b)], [v[b] for v in (own, low_a, low_b)])
    assert len(a) > 3000 and (need <= radius).mean() >= 0.99
    cells = len(grid.books[0]) * len(grid.books[1])
    _, seen = grid.visits(x, radius)
    share = np.mean([len(v) for v in seen]) / cells
    print(f"decay {decay}: {cells} cells, {share:.4f} of them visited, recall {(need <= radius).mean():.5f}")
    assert share < 0.1
    # the cells that `visits` lists are those within the radius, from the lower cell on
    met = np.array([own[i] == own[j] or max(own[i], own[j]) in seen[i if own[i] < own[j] else j] for i, j in zip(a, b, strict=True)])
    assert np.array_equal(met, need <= radius)


# --- 4 pages

PAGE = ("<html><body><div class=top>Site name</div><!-- <p>no</p> --><div><h1>T{0} &amp; more</h1><p>own  text {0}<br>line"
        "<p>last {0}<script>var x='<p>no</p>'</script></div><div>Imprint</div></body></html>")


def wrapper_brute(pages, references=None):
    """Texts of the pages of one host, all held at once: votes and region by plain loops over every block.

    ``references`` are the trees that may be aligned with; the first different page's, if none are given.
    """
    different = list(dict.fromkeys(pages))
    tree = None
    if len(different) > 1:
        tree = json.loads(json.dumps(page_wrapper.parse(references or different[0]).skeleton()))
    read = [[dict(zip([f for f, _ in page_wrapper.BLOCK], b, strict=True)) for b in page_wrapper.blocks_of(p, tree)] for p in pages]
    whole = [tuple(b["text"] for b in page if b["body"]) for page in read]
    voters = {w for w, page in zip(whole, read, strict=True) if any(not b["menu"] for b in page)}
    having, strict = collections.defaultdict(set), collections.defaultdict(bool)
    for w, page in zip(whole, read, strict=True):
        for b in page:
            if not b["menu"]:
                having[b["slot"], b["text"]].add(w)
                strict[b["slot"], b["text"]] |= b["declared"]
    constant = {c for c, w in having.items() if len(w) >= 3 and len(w) >= (0.5 if strict[c] else 0.3) * len(voters)}
    weight, chains = collections.Counter(), {}
    total = 0
    for page in read:
        for b in page:
            if not b["menu"] and (b["slot"], b["text"]) not in constant:
                total += b["weight"]
                for i, node in enumerate(b["chain"]):
                    weight[node] += b["weight"]
                    chains[node] = b["chain"][:i + 1]
    around = max((chains[n] for n in chains if weight[n] * 100 >= 80 * total), key=len, default=[])
    out = []
    for page in read:
        beyond = around and any(around[-1] in b["chain"] for b in page)
        out.append([b["text"] for b in page if not b["menu"] and (b["slot"], b["text"]) not in constant
                    and not (beyond and around[-1] not in b["chain"] and not b["strong"]) and set(b["named"]) <= set(around)])
    return out


def texts(page):
    return wrapper_brute([page])[0]


def test_page_wrapper(spark):
    rows = [(i, f"http://h.com/{i}", PAGE.format(i)) for i in range(8)] + [(8, "http://h.com/copy", PAGE.format(0))]
    rows += [(20, None, None), (21, "nohost", "<p>a</p>"), (22, "http://one.com", "<div><p>only</div>"), (23, "http://e.com/", ""),
             (24, "http://a.com/", "<nav>n</nav><div class='cookie-notice'>c</div><article><header><h1>H</h1>by</header><p>x"
              "<p>a < b</p><form>f</form><div id=comments>no</div></article><aside>s</aside><footer>&copy;</footer>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    out, (text, _, dropped) = page_wrapper.extract(df)
    got = {r["page_id"]: r for r in rows_of(out)}
    for i in range(8):
        assert got[i][text] == f"T{i} & more\n\nown text {i} line\n\nlast {i}" and got[i][dropped] == 2
    assert got[8][text] == got[0][text]
    assert [got[i][text] for i in (20, 21, 22, 23, 24)] == ["", "a", "only", "", "H\n\nx\n\na < b"]
    assert got[24]["text"] == "mine"
    assert page_wrapper.extract(empty(spark, "page_id long, url string, html string"))[0].count() == 0


def test_pages_that_declare_an_article_are_voted_on(spark):
    """Unnamed template inside an article goes; text outside a teaser article stays."""
    one = "<body><article><h1>T{0}</h1><div class=x>Tell your friends</div><p>own text {0}</p></article></body>"
    two = "<body><article><p>Read this too {0}</p></article><div><p>the long main text of page {0}</p></div><div>Imprint</div></body>"
    rows = [(i, f"http://a.com/{i}", one.format(i)) for i in range(6)]
    rows += [(10 + i, f"http://b.com/{i}", two.format(i)) for i in range(6)]
    rows += [(20, "http://c.com/", two.format(9)), (21, "http://d.com/", one.format(9))]
    out, (text, n, dropped) = page_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in rows_of(out)}
    for i in range(6):
        assert (got[i][text], got[i][n], got[i][dropped]) == (f"T{i}\n\nown text {i}", 3, 1)
        assert got[10 + i][text] == f"Read this too {i}\n\nthe long main text of page {i}" and got[10 + i][dropped] == 1
    assert got[20][text] == "Read this too 9\n\nthe long main text of page 9\n\nImprint"  # too few pages for a vote
    assert got[21][text] == "T9\n\nTell your friends\n\nown text 9"


def test_blocks_of_links_are_voted_on(spark):
    """Linked titles and paragraphs stay, a constant menu in one block goes by the vote, link items go at once."""
    page = ("<body><div><a href=/>Home</a> <a href=/n>News</a></div><div><h1><a href=/{0}>Title {0}</a></h1><p>text {0}</p>"
            "<p><a href=/r{0}>Reference {0}</a></p></div><ul><li><a href=/x{0}>x{0}</a><li><a href=/y>y</a></ul>"
            "<ul><li><a href=/s{0}>Source {0}</a></ul></body>")
    rows = [(i, f"http://a.com/{i}", page.format(i)) for i in range(5)]
    out, (text, _, dropped) = page_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in rows_of(out):
        i = r["page_id"]
        assert r[text] == f"Title {i}\n\ntext {i}\n\nReference {i}\n\nSource {i}" and r[dropped] == 1
    cards = "<div>" + "".join(f"<div><h2><a href=/{i}>Story {i}</a></h2></div>" for i in range(3)) + "</div>"
    assert texts(cards) == ["Story 0", "Story 1", "Story 2"]
    assert texts("<div><div><a href=1>a</a></div><div><a href=2>b</a></div></div><ul><li><p><a>c</a></p><li><a>d</a></ul>") == []


def test_names_of_elements():
    assert texts("<div class='has-sidebar'><div class='post-header'><h1>T</h1></div><p>x</div><div class=sideBar>s</div>"
                 "<div id=ad-1>a</div><div class=adder>kept</div>") == ["T", "x", "kept"]
    assert texts("<article><div class=entry-header><h1>T</h1></div>x<section class='user-comments'><article>c</article>"
                 "</section></article>") == ["T", "x"]
    assert texts("<p>a<ul><li><a href=1>Home</a><li><a href=2>News</a></ul><p>b <a href=x>c</a> d e f g") == ["a", "b c d e f g"]
    assert texts("<p>&lt;b&gt; &amp;amp; &#233;&nbsp;&eacute; &bogus; & <b>x</b>y") == ["<b> &amp; é é &bogus; & xy"]
    # a name counts by its head word, and not if the page's text lies in the element
    assert texts("<article><h1>T</h1><section id=share-price><p>up</p></section><p class=notice-period>a month</p>"
                 "<p class=share-buttons>tell</p><p>x</p></article>") == ["T", "up", "a month", "x"]
    assert texts("<body><form id=aspnetForm><nav>n</nav><div><h1>T</h1><p>one text</p><p>more text</p></div><footer>f</footer>"
                 "</form></body>") == ["T", "one text", "more text"]


def layout(rng, kind, i):
    """A page of a made layout, and what of it is its own."""
    words = lambda n: " ".join(rng.choice(["sun", "rain", "wind", "snow", "fog", "hail"]) + str(rng.randrange(999)) for _ in range(n))
    own = [words(4)] + [words(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 6))]
    body = f"<h1>{own[0]}</h1>" + "".join(f"<p>{x}</p>" for x in own[1:])
    head = f"<div><span>{words(2)}</span></div>" * (rng.random() < 0.6) + "<ul>" + "".join(
        f"<li><a href=/{j}>{words(1)}</a></li>" for j in range(rng.randrange(2, 6))) + "</ul>"
    foot = f"<div>All rights with h{kind}</div><div>{words(5)}</div>"
    if kind == 0:
        return f"<body>{head}<div class=x>{body}</div>{foot}</body>", own
    if kind == 1:
        return f"<body><section>{head}</section><section><div>Read on</div>{body}</section><section>{foot}</section></body>", own
    return f"<body><table><tr><td>{head}</td><td>{body}</td></tr></table><div>{foot}</div></body>", own


def test_page_wrapper_against_brute_force(spark):
    """Layouts without a telling name: Spark equals plain loops, furniture goes, own text stays, at every size of a host."""
    rng = random.Random(3)
    rows, wanted, own = [], {}, {}
    for host in range(12):
        pages = [layout(rng, host % 3, i) for i in range([1, 2, 4, 9][host // 3])]
        pages.append(pages[-1])  # a copy
        rows += [(len(rows) + i, f"http://h{host}.com/{i}", p) for i, (p, _) in enumerate(pages)]
        at = len(rows) - len(pages)
        # every possible reference gives the same texts, so the choice of one doesn't matter
        found = [wrapper_brute([p for p, _ in pages], r) for r in {p for p, _ in pages}]
        for i, (_, o) in enumerate(pages):
            wanted[at + i] = {"\n\n".join(f[i]) for f in found}
            own[at + i] = o
    out, (text, _, _) = page_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r[text] for r in rows_of(out)}
    assert all(got[i] in wanted[i] for i in wanted) and len(got) == len(rows)
    clean = 0
    for i, o in own.items():
        parts = got[i].split("\n\n")
        assert all(x in parts for x in o)  # nothing of its own is lost
        clean += parts == o or parts == ["Read on", *o] or parts == [o[0], "Read on", *o[1:]]
    print(f"{clean} of {len(own)} pages clean")
    assert clean == len(own)


def test_tree_matching_keeps_order():
    a = ["body", [["div", [], [1]], ["p", [], [2]], ["ul", [["li", [], [4]]], [3]]], [0]]
    b = ["body", [["p", [], [1]], ["div", [], [2]], ["ul", [["li", [], [4]]], [3]]], [0]]
    found = {}
    page_wrapper.match(a, b, found)
    assert found[0] == 0 and found[3] == 3 and found[4] == 4 and len(found) == 4  # either div or p, not both


def test_unclosed_elements_end_with_their_block():
    assert texts('<p>a <svg class="x"/> b</p><p>c</p><svg viewBox="0" /><p>d</p>') == ["a b", "c", "d"]
    for tag in ("button", "select", "noscript", "template", "svg", "iframe"):
        assert texts(f"<div><{tag}>menu</div><p>one</p><p>two</p><div><{tag}>x</{tag}></div><p>three</p>") == ["one", "two", "three"]
        assert texts(f"<body><p>a</p><{tag}>menu<p>rest</p>") == ["a", "rest"]
        assert texts(f"<p>a</p><{tag}><p>in</p></{tag}><p>b <{tag}>in</{tag}>c</p>") == ["a", "b c"]
    assert texts("<svg><svg></svg><foreignObject><div>in</div></foreignObject></svg><p>out") == ["out"]
    assert texts("<p>a<script>x<p>y") == ["a"]


@pytest.mark.parametrize("page", ["<svg>" * 20000, "<button>" * 20000 + "</button>", "<div><svg>" * 5000 + "</div>" * 5000])
def test_unclosed_elements_are_linear(page):
    page_wrapper.blocks_of(page)


def test_odd_markup_is_linear():
    for page in ('<a "' * 20000, "<p>" * 5000 + "x", "<div>" * 5000 + "x", "<" * 50000, "<script>" * 3000, "</p>" * 5000):
        page_wrapper.blocks_of(page)


# --- 5 URLs

def test_url_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (0, "http://x.example.org/a", link.format("https://spam.net/x")), (1, "http://spam.net/x?utm_source=1#f", ""),
        (2, "HTTP://Q.Example.NET/en/z", ""), (3, "http://q.org/a", link.format("//q.example.net/en/z")),
        (4, "http://w.org/r", '<meta http-equiv=refresh content="0; url=/fr/x">'), (5, "http://w.org/", "<!-- " + link.format("http://a.net/") + " -->"),
        (6, None, None), (7, "nothing", "x"), (8, "http://net", ""), (9, "http://a.net:80/", ""), (10, "http://m.org/a/", None),
        (11, "https://m.org/a", link.format("http://b.net/")), (12, "://net/x", ""), (13, "http://bnet/", ""),
        (14, "http://k.org/1", link.format("http://spam.net/x")), (15, "http://k.org/1", link.format("/2")), (16, "http://k.org/2", ""),
        (17, "http://slow.org/", '<meta http-equiv="refresh" content="600; url=http://a.net/">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    got = {r["page_id"]: r for r in rows_of(url_aliases.judge(df))}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == {
        0: (None, "block"), 1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: (None, "allow"), 4: (None, "allow"),
        5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"),
        10: (None, "block"), 11: (None, "block"), 12: ("net/", "block"), 13: (None, "allow"), 14: (None, "block"),
        15: (None, "block"), 16: (None, "block"), 17: (None, "block")}
    assert (got[2]["host"], got[2]["path"], got[6]["host"], got[7]["path"], got[8]["path"]) == ("q.example.net", "/en/z", "", "", "")
    assert url_aliases.judge(empty(spark, "page_id long, url string, html string")).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (5000, 5000), (1, None)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[2000 + i] == 1000 for i in range(50)) and got[5000] == 5000
    assert common.components(empty(spark, "a long, b long"), "a", "b").count() == 0


def test_components_of_random_graphs(spark):
    """Components against union by hand: sparse and dense graphs, a hub, loops, repeats, null ends."""
    rng = random.Random(12)
    for n, m in ((60, 30), (60, 70), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges += edges[:5] + [(0, i) for i in range(0, n, 9)] + [(None, 3), (4, None)]
        label = {x: x for e in edges for x in e if None not in e}
        for _ in label:
            for a, b in edges:
                if a is not None and b is not None:
                    label[a] = label[b] = min(label[a], label[b])
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r.node: r.root for r in common.components(df, "a", "b").collect()}
        assert got == label


def test_small_staged_tables_are_few_files(spark, monkeypatch):
    """Tables of a known small size are one file each, however many partitions made them; no row is lost."""
    from pathlib import Path
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    written, plain = collections.defaultdict(list), common.scratch_path

    def path_of(session, name):
        written[name].append(plain(session, name))
        return written[name][-1]

    monkeypatch.setattr(common, "scratch_path", path_of)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 2000 + i) for i in range(50)]
    texts = [f"{' '.join(f'w{i}x{j}' for j in range(40))}\nthe same line on every site" for i in range(60)]
    rows = [(i, t + " end" * (i >= 60), f"site{i}") for i, t in enumerate(texts * 2)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        roots = common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "path", rows=len(edges))
        assert {r.root for r in roots.collect()} == {0, 1000} and roots.count() == 92
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert sorted(r.doc_id for r in oph_dedup.keep_first(df).collect()) == list(range(60))
        assert {r.text for r in line_spread.remove(df.where("doc_id < 60")).collect()} == {t.split("\n")[0] for t in texts}
        assert common.staged(spark.range(0, 1000, 1, 30), "ids", 2 * common.FILE_BYTES + 1).count() == 1000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = {name: max(len(list(Path(p.removeprefix("file:")).glob("part-*"))) for p in paths) for name, paths in written.items()}
    assert len(written["path"]) > 2 and files.pop("ids") == 3
    for name in ("path", "nodes", "node-sketches", "clusters", "linked", "gone", "line-sites", "spread-lines", "text-lines"):
        assert files[name] == 1, name


# --- 6 secrets

def secrets_brute(text):
    patterns = [r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    out = []
    for k, (p, least) in enumerate(zip(patterns, (8, 16, 32))):
        out += [(m.start(), m.end(), k) for m in re.finditer(p, text) if len(m[1] if not k else m[0]) >= least]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secrets(spark):
    rng = random.Random(4)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "=", ":", " ", '"', "'", "abcdef01",
             "0123456789abcdef" * 2, "é", "ſecret", "ABCDEFGHIJKL0123", "ß\n", "ghp_", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + ["a" * 100_000, None, ""]
    for t in texts[:-2]:
        assert [tuple(s) for s in secret_scan.find(t) if s.kind < 3] == secrets_brute(t)
    token = "ghp_" + "x" * 30 + secret_scan.checksum62(b"x" * 30).decode()
    assert secret_scan.listed(secret_scan.find(f"é {token}.")) == "github:2:42" and not secret_scan.find(token[:-1] + "!")
    df = spark.createDataFrame([(i, t, "x", "s", 3) for i, t in enumerate([*texts, f"t {token}", "no secret"])], DOCS).withColumn("spans", F.lit(1))
    for r in rows_of(secret_scan.scan(df)):
        spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in secrets_brute(r["text"] or ""))
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest() and r["spans"] == 1
    clean = {r["doc_id"]: r for r in rows_of(secret_scan.redact(df))}
    assert clean[403]["text"] == "t [secret]" and clean[403]["n_chars"] == 10
    assert (clean[401]["text"], clean[404]["text"], clean[404]["n_chars"]) == (None, "no secret", 3)
    assert secret_scan.scan(empty(spark)).count() == 0


# --- 7 BPE

def test_bpe(spark, docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(word_bpe.default_vocabulary())
    rng = random.Random(8)
    more = ["".join(rng.choice("abcdefghij klmnop'ABC.,12éÉß\n\t́<|>") for _ in range(80)) for _ in range(200)]
    d = docs.unionByName(spark.createDataFrame([(5000 + i, t, "x", "s", 0) for i, t in enumerate(more)], DOCS))
    d = d.withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(7))
    for r in rows_of(word_bpe.encode(d)):
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert (r["_n_tokens"], r["_ids"], r["decoded"]) == (len(ids), ids, decoded) and r["ids"] == "mine"
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert word_bpe.encode(empty(spark)).count() == 0


def test_bpe_of_long_texts_in_steps(monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(word_bpe, "STEP_CHARS", 50)
    bpe = word_bpe.Codec(word_bpe.default_vocabulary())
    lib = Tokenizer.from_file(word_bpe.default_vocabulary())
    monkeypatch.setattr(bpe.words, "limit", 400)  # forgets after every few words
    monkeypatch.setattr(bpe.chunks, "limit", 400)
    for text in ["theing and " * 40, "a" * 300, " " * 200, "banana" * 50 + " x", "\n".join(vocabulary()), "日本 語 Σας ΑΣ ﬁ " * 30]:
        parts = [c for part in word_bpe.steps([text]) for c in bpe.coded([x for _, x in part])]
        ids = np.frombuffer(b"".join(parts), "<u4").tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids


# --- 8 lines

def test_line_spread(spark):
    rows = []
    for i in range(40):
        wide = "Subscribe to us now" if i < 20 else "rare line"
        rows.append((i, f"own words of text {i} that are long enough to matter here\n{wide}\nlast {i}", "en", f"s{i % (9 if i < 20 else 5)}", 1))
    rows += [(50 + i, "copied text line one\ncopied text line two", "en", f"s{i}", 1) for i in range(12)]
    rows += [(70, None, "en", None, None), (71, "", "en", "s1", 0), (72, "\n\n", "en", "s2", 2)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_lines", F.lit("mine"))
    out, (text, n, wide, whole) = line_spread.clean(df)
    for r in rows_of(out):
        i, want = r["doc_id"], r["text"]
        if i < 20:
            want = "\n".join(x for x in want.split("\n") if x != "Subscribe to us now")
        assert r[text] == want and r[whole] == (50 <= i < 70) and r["n_lines"] == "mine"
        assert r[n] == (0 if r["text"] is None else len(r["text"].split("\n")))
        assert r[wide] == (1 if i < 20 else 2 if 50 <= i < 70 else 0)
    assert line_spread.remove(df).columns == df.columns
    assert line_spread.remove(empty(spark)).count() == 0


# --- 9 near-duplicates

def shingles_brute(text, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORDS.findall((text or "").translate(low))
    k = min(size, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def groups_brute(rows, size):
    """Sets of row numbers, by comparing all pairs."""
    sets = [shingles_brute(r["text"], size) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(set)
    for i in range(len(rows)):
        groups[find(i)].add(i)
    return sets, list(groups.values())


def test_near_duplicates(spark, docs, monkeypatch):
    monkeypatch.setattr(oph_dedup, "BLOCK", 3)
    monkeypatch.setattr(oph_dedup, "SET_BLOCK", 2)
    out, (rid, n, component) = oph_dedup.near_duplicates(docs.withColumn("_row", F.lit(0)).withColumn("sig", F.lit(0)), size=2)
    got = rows_of(out)
    assert len(got) == docs.count()
    sets, groups = groups_brute(got, 2)
    assert [r[n] for r in got] == [len(x) for x in sets]
    for members in groups:
        assert {got[i][component] for i in members} == {min(got[i][rid] for i in members)}
    assert len(groups) < len(got)


def test_one_row_of_each_group_stays(spark, docs):
    rows = rows_of(docs)
    _, groups = groups_brute(rows, 5)
    kept = oph_dedup.keep_first(docs, size=5)
    assert kept.columns == docs.columns
    least = [min((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) for i in g) for g in groups]
    assert collections.Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == collections.Counter(least)
    assert oph_dedup.keep_first(empty(spark)).count() == 0


# --- 10 packing

def test_packing(spark, docs):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(word_bpe.default_vocabulary())
    d = docs.withColumn("_rid", F.lit(1)).withColumn("offset", F.lit(1))
    got = rows_of(cutting_stock.pack(d))
    ids = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append(lib.encode(r.text or "", add_special_tokens=False).ids + [2])
    pieces = collections.Counter()
    for doc, v in ids.items():
        for x in v:
            for at in range(0, len(x), 4096):
                data = x[at:at + 4096]
                pieces[doc, at, len(data), zlib.crc32(np.array(data, "<u4").tobytes()), len(x)] += 1
    assert pieces == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in fill.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    assert sorted(fill) == list(range(len(fill)))
    assert cutting_stock.pack(empty(spark)).count() == 0


def best_sequences(lengths):
    """Fewest sequences by a bound: tokens, or, where at most k pieces fit, the best matching of two or counts of k."""
    least = math.ceil(lengths.sum() / 4096)
    k = 4096 // int(lengths.min())
    if k == 1:
        return len(lengths)
    if k == 2:  # the longest takes the shortest that is left, if it can
        rest, i, n = np.sort(lengths), 0, 0
        for x in rest[::-1]:
            if n + i >= len(rest):
                break
            n, i = n + 1, i + (i < len(rest) - n - 1 and x + rest[i] <= 4096)
        return n
    return max(least, math.ceil(len(lengths) / k)) if lengths.min() * k > 4096 - lengths.min() else least


@pytest.mark.parametrize("kind", ["mixed", "one length", "short", "few", "tail", "1360", "around 1355", "around 1020", "two bands", "halves"])
def test_plan_places_every_rank_once(kind):
    rng = np.random.default_rng(3)
    n = {"few": 7, "tail": 3000}.get(kind, 8000)
    lengths = {"mixed": np.clip(rng.lognormal(6.5, 1.1, n).astype(int) + 1, 1, 4096), "one length": np.full(n, 1365),
               "short": rng.integers(1, 60, n), "few": rng.integers(1, 4097, n), "tail": rng.integers(1900, 4097, n),
               "1360": np.full(n, 1360), "around 1355": rng.normal(1355, 8, 20_000).astype(int),
               "around 1020": rng.normal(1020, 6, n).astype(int), "halves": rng.integers(2040, 2056, n),
               "two bands": np.concatenate([rng.normal(2700, 9, n).astype(int), rng.normal(1385, 9, n).astype(int)])}[kind]
    histogram = collections.Counter(lengths.tolist())
    plan = cutting_stock.Plan(dict(histogram))
    fill, seen = collections.defaultdict(list), collections.Counter()
    for length, a, b, per, seq, offset in plan.rows:
        for r in range(a, b):
            fill[seq + (r - a) // per].append((offset + (r - a) % per * length, length))
            seen[length] += 1
    assert seen == histogram and sorted(fill) == list(range(plan.sequences))
    for v in fill.values():
        at = 0
        for o, length in sorted(v):
            assert o == at
            at += length
        assert at <= 4096
    if kind != "few":
        assert plan.sequences <= 1.03 * best_sequences(lengths) + 1
    if kind in ("one length", "1360"):
        assert plan.sequences == math.ceil(n / 3)


def test_classes_and_patterns():
    histogram = {n: 1 + n % 3 for n in range(65, 4096, 3)} | {1365: 10_000}
    got = cutting_stock.classes(histogram, 20)
    assert len(got) == 20 and sorted(x for g in got for x in g) == sorted(histogram)
    assert got == sorted(got, key=lambda g: g[0]) and any(g[0] == 1365 for g in got)
    assert cutting_stock.classes({5: 1, 7: 2}) == [[5], [7]] and cutting_stock.classes({}) == []
    rng = random.Random(4)
    for _ in range(40):  # the knapsack against all ways to fill
        sizes = np.array(sorted(rng.sample(range(1, 30), 4)))
        values = np.array([rng.random() for _ in sizes])
        best = [0.0] * 41
        for c in range(1, 41):
            best[c] = max([best[c - 1]] + [best[c - s] + v for s, v in zip(sizes.tolist(), values.tolist(), strict=True) if s <= c])
        worth, pattern = cutting_stock.price(sizes, values, 40)
        assert abs(worth - best[40]) < 1e-9 and abs(pattern @ values - worth) < 1e-9 and pattern @ sizes <= 40
