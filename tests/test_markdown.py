"""Markdown by the public specification's rules: blocks, inlines, tables, footnotes, hostile texts."""

import time

import pytest

from quillbase.functions.markdown import to_html

CASES = [
    # blocks
    ("", ""), ("a\nb\n\n\nc", "<p>a\nb</p>\n<p>c</p>\n"), ("  aaa\n bbb", "<p>aaa\nbbb</p>\n"),
    ("# foo\n###### foo\n####### foo", "<h1>foo</h1>\n<h6>foo</h6>\n<p>####### foo</p>\n"), ("#5 bolt\n\n#hashtag", "<p>#5 bolt</p>\n<p>#hashtag</p>\n"), ("## foo ##\n### foo ### b\n# foo#", "<h2>foo</h2>\n<h3>foo ### b</h3>\n<h1>foo#</h1>\n"), ("### a #\n# #\n## b\\# ##", "<h3>a</h3>\n<h1></h1>\n<h2>b#</h2>\n"), ("#\n## ", "<h1></h1>\n<h2></h2>\n"),
    ("Foo *bar*\n=========\n\nFoo\n---", "<h1>Foo <em>bar</em></h1>\n<h2>Foo</h2>\n"), ("Foo\nbar\n===", "<h1>Foo\nbar</h1>\n"), ("***\n---\n___\n- - -\n--", "<hr />\n<hr />\n<hr />\n<hr />\n<p>--</p>\n"), ("Foo\n***\nbar", "<p>Foo</p>\n<hr />\n<p>bar</p>\n"),
    ("    a simple\n      code\n\n\n    more\n", "<pre><code>a simple\n  code\n\n\nmore\n</code></pre>\n"), ("\tfoo\tbaz", "<pre><code>foo\tbaz\n</code></pre>\n"),
    ("```rust x\n<a>\n\n\tb\n```\nafter", '<pre><code class="language-rust">&lt;a&gt;\n\n\tb\n</code></pre>\n<p>after</p>\n'), ("~~~\n```\n~~~~", "<pre><code>```\n</code></pre>\n"), ("```\nopen", "<pre><code>open\n</code></pre>\n"), ("  ```\n  aaa\n    b\n  ```", "<pre><code>aaa\n  b\n</code></pre>\n"),
    ("> # Foo\n> bar\nbaz", "<blockquote>\n<h1>Foo</h1>\n<p>bar\nbaz</p>\n</blockquote>\n"), ("> foo\n---", "<blockquote>\n<p>foo</p>\n</blockquote>\n<hr />\n"), ("> > a\n> b\n\n> c", "<blockquote>\n<blockquote>\n<p>a\nb</p>\n</blockquote>\n</blockquote>\n<blockquote>\n<p>c</p>\n</blockquote>\n"), (">", "<blockquote>\n</blockquote>\n"),
    ("- a\n- b\n\n\ntext", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<p>text</p>\n"), ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"), ("* a\n* b\n+ c", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<ul>\n<li>c</li>\n</ul>\n"),
    ("- a\n  - b\n    - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"), ("3. a\n4. b\n5) c", '<ol start="3">\n<li>a</li>\n<li>b</li>\n</ol>\n<ol start="5">\n<li>c</li>\n</ol>\n'),
    ("1.  A paragraph\n    with two lines.\n\n        indented code\n\n    > A block quote.", "<ol>\n<li>\n<p>A paragraph\nwith two lines.</p>\n<pre><code>indented code\n</code></pre>\n<blockquote>\n<p>A block quote.</p>\n</blockquote>\n</li>\n</ol>\n"),
    ("- a\n  - b\n\n    c\n- d", "<ul>\n<li>a\n<ul>\n<li>\n<p>b</p>\n<p>c</p>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>\n"), ("- one\n\n two", "<ul>\n<li>one</li>\n</ul>\n<p>two</p>\n"), ("The number is\n14.  doors\n1. x", "<p>The number is\n14.  doors</p>\n<ol>\n<li>x</li>\n</ol>\n"), ("- foo\n-\n- bar", "<ul>\n<li>foo</li>\n<li></li>\n<li>bar</li>\n</ul>\n"), ("-\n\n  foo", "<ul>\n<li></li>\n</ul>\n<p>foo</p>\n"),
    ("- # Foo\n- Bar\n  ---\n  baz", "<ul>\n<li>\n<h1>Foo</h1>\n</li>\n<li>\n<h2>Bar</h2>\nbaz</li>\n</ul>\n"), ("> 1. > Blockquote\ncontinued here.", "<blockquote>\n<ol>\n<li>\n<blockquote>\n<p>Blockquote\ncontinued here.</p>\n</blockquote>\n</li>\n</ol>\n</blockquote>\n"),
    ("<div>\n*hi*\n\n*a*", "<div>\n*hi*\n<p><em>a</em></p>\n"), ("<!-- a\n\nb -->\nc", "<!-- a\n\nb -->\n<p>c</p>\n"), ("a\n<del>\nb", "<p>a\n<del>\nb</p>\n"),
    # inlines
    ("*a* **b** ***c*** _d_ __e__", "<p><em>a</em> <strong>b</strong> <em><strong>c</strong></em> <em>d</em> <strong>e</strong></p>\n"), ("a * b * c*\nsnake_case_word 5*6*78", "<p>a * b * c*\nsnake_case_word 5<em>6</em>78</p>\n"), ("**foo*bar**", "<p><strong>foo*bar</strong></p>\n"), ("*foo**bar**baz*", "<p><em>foo<strong>bar</strong>baz</em></p>\n"), ("foo***bar***baz", "<p>foo<em><strong>bar</strong></em>baz</p>\n"), ("**foo bar **", "<p>**foo bar **</p>\n"), ("*(*foo*)*", "<p><em>(<em>foo</em>)</em></p>\n"), ("*foo**bar*", "<p><em>foo**bar</em></p>\n"), ("****foo*", "<p>***<em>foo</em></p>\n"), ("**foo*", "<p>*<em>foo</em></p>\n"),
    ("`a` `` b`c `` `<d>`\n`open", "<p><code>a</code> <code>b`c</code> <code>&lt;d&gt;</code>\n`open</p>\n"), ("`a\\`b", "<p><code>a\\</code>b</p>\n"), ("*foo`*`", "<p>*foo<code>*</code></p>\n"),
    ("a  \nb\\\nc \nd", "<p>a<br />\nb<br />\nc\nd</p>\n"), ("\\*no\\* \\a 1 < 2 & \"q\"", "<p>*no* \\a 1 &lt; 2 &amp; \"q\"</p>\n"), ("&copy; &amp; &#35; &#x22; &nope; &", "<p>© &amp; # \" &amp;nope; &amp;</p>\n"),
    ('[l](/u "t") [m](<a b>) [n]() ![i *x*](u.png)', '<p><a href="/u" title="t">l</a> <a href="a%20b">m</a> <a href="">n</a> <img src="u.png" alt="i x" /></p>\n'), ("[a [b](c)](d)", '<p>[a <a href="c">b</a>](d)</p>\n'), ("[link](foo(and(bar)))", '<p><a href="foo(and(bar))">link</a></p>\n'), ("[a] [x][a] [A][] [b]\n\n[a]: /u 'T'\n[b]: <>\n", '<p><a href="/u" title="T">a</a> <a href="/u" title="T">x</a> <a href="/u" title="T">A</a> <a href="">b</a></p>\n'), ("[foo]: /url\n[foo]", '<p><a href="/url">foo</a></p>\n'), ("*[a*](b)", '<p>*<a href="b">a*</a></p>\n'), ("[not](a b)", "<p>[not](a b)</p>\n"), ("![[a](b)](c)", '<p><img src="c" alt="a" /></p>\n'),
    ("<http://a.b/?q=1&x> <m@e.org> <b c='1'> <3", '<p><a href="http://a.b/?q=1&amp;x">http://a.b/?q=1&amp;x</a> <a href="mailto:m@e.org">m@e.org</a> <b c=\'1\'> &lt;3</p>\n'),
    # extensions
    ("| a | b |\n|:--|:-:|\n| *1* | x\\|y | z |\n| 2\n\nend", '<table><thead><tr><th style="text-align: left">a</th><th style="text-align: center">b</th></tr></thead><tbody>\n<tr><td style="text-align: left"><em>1</em></td><td style="text-align: center">x|y</td></tr>\n<tr><td style="text-align: left">2</td><td style="text-align: center"></td></tr>\n</tbody></table>\n<p>end</p>\n'), ("a | b\n- | -\n> q", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody>\n</tbody></table>\n<blockquote>\n<p>q</p>\n</blockquote>\n"), ("| a |\n| - | - |", "<p>| a |\n| - | - |</p>\n"),
    ("see[^n] and[^x][^n]\n\n[^n]: The *note*.\n    more", '<p>see<sup class="footnote-reference"><a href="#n">1</a></sup> and[^x]<sup class="footnote-reference"><a href="#n">1</a></sup></p>\n<div class="footnote-definition" id="n"><sup class="footnote-definition-label">1</sup>\n<p>The <em>note</em>.\nmore</p>\n</div>\n'),
]


@pytest.mark.parametrize("source, want", CASES, ids=range(len(CASES)))
def test_rules(source, want):
    assert to_html(source) == want


def test_null():
    assert to_html(None) is None


@pytest.mark.parametrize("source", ["*a " * 20_000, "[" * 20_000 + "]" * 20_000, "`" * 3 + "a`" * 20_000, "**x* " * 10_000, "a](b" * 20_000, "<" * 50_000, "![" * 20_000, "- " * 3_000 + "x", ">" * 3_000 + "x", "\\" * 50_000, "&" * 50_000, "*a _b " * 10_000, "|" * 30_000, "# a" + " " * 200_000 + "x", "a | b\n-" + " " * 200_000 + "-", "a | b\n" + " " * 200_000 + "x", "a\n=" + " " * 200_000 + "x", "<a b" + " " * 200_000 + "c", "* " * 20_000, ("a" + " " * 500) * 400, "<!-- " * 10_000], ids=range(21))
def test_hostile_texts_end(source):
    begin = time.perf_counter()
    assert to_html(source)
    assert time.perf_counter() - begin < 20
