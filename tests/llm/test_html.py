"""HTML extraction: made pages of known text, and repeated runs against brute force."""

import random

import numpy as np
import pytest

from walkloom.llm import html_extract as he

LETTERS = "bcdfglmnprstv"


def prose(rng, n):
    return " ".join("".join(rng.choice(LETTERS) + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("page, text", [
    ("", []),
    ("plain &amp; simple", ["plain & simple"]),
    ("<p>one<p>two", ["one", "two"]),
    ("<div>a<br>b&nbsp; c\n\t d</div>", ["a b c d"]),
    ("<body><nav>menu</nav><article><h1>T &lt;x&gt;</h1><p><b>A<br><p>B <i>c</i>d</p><script>var a='</p><p>no</p>';</script><aside>side</aside></article><footer>f</footer>", ["T <x>", "A", "B cd"]),
    ("<title>t</title><style>p{}</style><p>x", ["x"]),
    ("<head><title>t</title><meta charset=x><p>body begins</p>", ["body begins"]),
    ("<div class='ad'>buy</div><div id=sidebar>s</div><div class='post content'>text</div><div class='cookieNotice'>c</div><div class=comments><p>hi</p></div>", ["text"]),
    ("<article>main<article>a reader</article><div class='commentList'>b reader</div><footer>tags</footer></article>", ["main"]),
    ("<article class='comment'>x</article><main><header>head</header><p>y</p></main><p>z</p>", ["y"]),
    ("<form action=/><label>name</label><input><main><p>whole page</p></main></form>", ["whole page"]),
    ("<form>Subscribe <button>go</button></form><p>t</p>", ["t"]),
    ("<ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul><p>See <a href=/>this</a> text, that is longer.</p>", ["See this text, that is longer."]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p title='a > b' class=\"x\">q</p><p hidden>h</p><div style='display: none'>n</div><div aria-hidden=true>i</div>", ["q"]),
    ("<!-- <p>no</p> --><!-- x > --><p>yes</p><!-- open <p>gone</p>", ["yes"]),
    ("<div><article><p>in</p></div><p>out</p></article>", ["in"]),
    ("<p>a < b &#233; &#x41; &bogus; &copy</p>", ["a < b é A &bogus; ©"]),
    ("<article><span class='ad'>buy</span>text <span class=x>more</span></article>", ["text more"]),
    ("<script>never closed <p>x</p>", []),
    ("<noscript>no close <p>x</p>", ["no close", "x"]),
    ("<body class='nav-open has-sidebar'><p>t</p><div hidden=hidden>x</div></body>", ["t"]),
    ('<p>a</p><img alt="never closed <p>b', ["a", "b"]),
])
def test_blocks(page, text):
    article, others = he.split(he.blocks(page))
    assert (article or [t for t, k in others if k == he.OPEN]) == text


@pytest.mark.parametrize("cut", range(0, 260, 7))
def test_cut_pages(cut):
    """Pages that end anywhere, or lack a piece, give blocks and don't raise."""
    page = "<!DOCTYPE html><html><head><title>t</title></head><body class=\"x\"><nav><ul><li><a href='/'>n</a></li></ul></nav><article><h1>T</h1><p>a &amp; b</p><!-- c --><script>x()</script><p>c</p></article><footer>&copy; f</footer></body></html>"
    assert all(t and t == " ".join(t.split()) for t, _ in he.blocks(page[:cut]) + he.blocks(page[:cut] + page[cut + 9 :]))


def naive(streams, digests, depth):
    """For each page, which tokens lie in a run that a page of other text has too."""
    where = {}
    for s, d in zip(streams, digests):
        for i in range(len(s) - depth + 1):
            where.setdefault(tuple(s[i : i + depth]), set()).add(d)
    out = []
    for s in streams:
        hit = [False] * len(s)
        for i in range(len(s) - depth + 1):
            if len(where[tuple(s[i : i + depth])]) > 1:
                hit[i : i + depth] = [True] * depth
        out.append(hit)
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 10])
def test_repeated(depth):
    rng = random.Random(depth)
    for _ in range(30):
        streams = [[rng.randrange(5, 5 + rng.choice([2, 4, 30])) for _ in range(rng.randint(0, 40))] for _ in range(rng.randint(1, 8))]
        streams += [list(s) for s in streams[:2]]
        digests = [hash(tuple(s)) for s in streams]
        ended = [[x | 1 << 63 for x in s] + [k + 1] for k, s in enumerate(streams)]
        tokens, page = np.array(sum(ended, []), "u8"), np.repeat(np.arange(len(streams)), [len(s) for s in ended])
        got = he.repeated(tokens, page, np.array(digests), depth=depth)
        assert got.tolist() == sum((x + [False] for x in naive(streams, digests, depth)), [])


def test_suffix_order():
    """Suffixes stand in the order of their first tokens."""
    rng = random.Random(1)
    tokens = np.array([rng.randrange(1, 4) for _ in range(500)], "u8")
    order, rank = he.suffix_array(tokens, 7)
    first = [tuple(tokens[i : i + 7]) for i in order]
    assert first == sorted(first) and sorted(order) == list(range(500))
    assert all((rank[order[k]] == rank[order[k + 1]]) == (first[k] == first[k + 1]) for k in range(499))


@pytest.fixture(scope="module")
def site():
    """Hosts of plain divisions, where only repetition tells what is no text, and what each page says."""
    rng, rows, want = random.Random(4), [], {}
    for h in range(6):
        menu = [prose(rng, rng.randint(1, 3)) for _ in range(8)]
        line, legal = prose(rng, 14), prose(rng, 25)
        for _ in range(40 if h == 0 else 6):
            k = len(rows)
            body = [prose(rng, rng.randint(3, 60)) for _ in range(rng.randint(2, 6))]
            shown = list(body)
            body[1] += " " + legal if k % 3 == 0 else ""  # a run within a block
            page = "".join(f"<div>{x}</div>" for x in [*menu, line, *body, legal, line])
            rows.append((k, f"http://host{h}.example.org/{k}", f"<html><body>{page}"))
            want[k] = "\n".join(shown)
    copies = [(1000 + k, "http://other.example.org/x", rows[0][2]) for k in range(5)]
    near = [prose(rng, 300) for _ in range(3)]
    almost = ["".join(f"<p>{x}</p>" for x in [*near, f"Number {k}."]) for k in range(2)]
    copies += [(2000 + k, "https://u@NEAR.example.org:80/", x) for k, x in enumerate(almost)]
    want |= {2000 + k: "\n".join([*near, f"Number {k}."]) for k in range(2)}
    rows += copies + [(3000, None, None), (3001, "odd", ""), (3001, "odd", ""), (None, "odd", "<p>no id</p>"), (3002, "http://host1.example.org/a", "<article><p>" + "long " * 50_000 + "</p></article><div>x</div>")]
    return rows, want


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", "x", 1) for r in rows], "page_id long, url string, html string, host string, text string, part long").repartition(5)


def test_extract(spark, site):
    rows, want = site
    got = he.extract(table(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert {k: text[k] for k in want} == want
    assert text[3000] == text[3001] == "" and text[None] == "no id" and text[3002] == ("long " * 50_000).strip()
    assert len({text[1000 + k] for k in range(5)}) == 1 and text[1000].count("\n") > 8  # copies don't remove each other


def test_split_hosts(spark, site):
    """Hosts split in many groups give the same as whole ones."""
    rows, _ = site
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(he.extract(table(spark, rows))) == plain(he.extract(table(spark, rows), host_chars=4000))
    assert he.extract(table(spark, [])).count() == 0
