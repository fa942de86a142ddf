import math
import random
from html.parser import HTMLParser

from lexmill.llm import html_density

PAGES = "page_id long, url string, html string, text string, node string"


class Tree(HTMLParser):
    """Builds nested nodes of well-formed pages."""

    def __init__(self):
        super().__init__()
        self.root = ["#root", [], []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, [], []]
        self.stack[-1][1].append(node)
        if tag != "br":
            self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def brute(page):
    """Greatest density sum in the body, by the definition."""
    t = Tree()
    t.feed(page)

    def measure(node, in_link):
        in_link = in_link or node[0] == "a"
        own = sum(len(" ".join(x.split())) if x.strip() else 0 for x in node[2])
        c, tags, k, links = own, 1, own if in_link else 0, int(node[0] == "a")
        for child in node[1]:
            a, b, d, e = measure(child, in_link)
            c, tags, k, links = c + a, tags + b, k + d, links + e
        node.append((c, tags, k, links))
        return node[3]

    measure(t.root, False)
    body = next(x for x in t.root[1][0][1] if x[0] == "body")
    share = body[3][2] / body[3][0]

    def density(node):
        c, tags, k, links = node[3]
        if not c:
            return 0.0
        inside = c * tags / (max(k, 1) * max(links, 1))
        return c / tags * math.log(inside) / max(math.log(math.log(c * k / max(c - k, 1) + share * c + math.e) + 1e-9), 1e-3) if inside > 1 else 0.0

    best = 0.0
    todo = [body]
    while todo:
        node = todo.pop()
        best = max(best, sum(map(density, node[1])))
        todo += node[1]
    return best


def page(rng, n):
    text = lambda k: " ".join(f"word{rng.randrange(99)}" for _ in range(k))
    nav = "".join(f'<li><a href="/{i}">{text(1)}</a></li>' for i in range(rng.randrange(3, 12)))
    paragraphs = [text(rng.randrange(20, 60)) for _ in range(n)]
    body = "".join(f"<p>{p}<br></p>" for p in paragraphs)
    return f"<html><head></head><body><div><ul>{nav}</ul></div><div>{text(3)}</div><article><h1>{text(4)}</h1>{body}</article><footer>{text(2)} <a>{text(2)}</a></footer></body></html>", paragraphs


def test_greatest_sum_equals_brute_force():
    rng = random.Random(8)
    for n in range(2, 25):
        p, _ = page(rng, n)
        assert math.isclose(html_density.extract(p)[2], brute(p), rel_tol=1e-9)


def test_main_text_without_navigation():
    rng = random.Random(11)
    for n in range(3, 20):
        p, paragraphs = page(rng, n)
        text, node, _, _ = html_density.extract(p)
        assert node == "body/article" and all(x in text.split("\n") for x in paragraphs) and len(text.split("\n")) == n + 1


def test_broken_markup():
    text = html_density.extract("<body><div><p>One is a text of some length here<p>Two <b>bold is also a longer text</div></i><script>no</script><!-- open comment")[0]
    assert text == "One is a text of some length here\nTwo bold is also a longer text"
    assert html_density.extract("no tags at all")[0] == "no tags at all"
    assert html_density.extract("<" * 50)[0] == "<" * 50 and html_density.extract("<p>a &lt; b</p>")[0] == "a < b"


def test_edges(spark):
    p, _ = page(random.Random(1), 5)
    rows = [(1, "u", p), (1, "u", p), (2, None, None), (None, "u", ""), (3, "u", "<div>" * 3000 + "deep"), (4, "u", "<p>word " * 100000)]
    got = html_density.extract_text(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert [r.text for r in got if r.page_id == 3] == ["deep"] and all(len(r.text.split("\n")) == 100000 for r in got if r.page_id == 4)
    assert html_density.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_quoted_values_and_slashes():
    from lexmill.llm.html_density import Dom

    dom = Dom('<body><p title="a>b" x=\'c>d\' href=e>one</p><div/>two<p t=don\'t>three > four</p><i a = "q>r">five</i><p x="never closed>six</p></body>')
    assert "".join(t for _, t in dom.pieces) == "onetwothree > fourfivesix"
    assert [dom.tags[n] for n, t in dom.pieces if t == "two"] == ["div"]
    assert dom.tags.count("p") == 3
    long = "<p " + 'a="' * 20000 + ">end"
    assert "".join(t for _, t in Dom(long).pieces).endswith("end")


def test_ties_repeats_and_names(spark):
    same = "<body><div><p>" + "words " * 30 + "</p></div><div><p>" + "words " * 30 + "</p></div></body>"
    rows = [(1, "u", same, "x", 2), (1, "u", same, "y", 3), (2, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_density.extract_text(pages).orderBy("page_id").collect()
    assert len(got) == 3 and got[0] == got[1] and got[0].node == "body" and got[2].text == ""
    assert html_density.extract_text(pages.limit(0)).count() == 0
