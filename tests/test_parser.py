"""Tree-builder rules of the N1 parse (pure Python, no Spark)."""

from pagemill.operators.dom import parse_document


def tree(html):
    text, b = parse_document(html)
    return text, [(b.tags[i], b.parent[i], b.last[i], b.starts[i], b.ends[i]) for i in range(len(b.tags))]


def test_no_implied_end_tags_p_nests():
    text, nodes = tree("<p>a<p>b</p>c")
    assert text == "abc"
    assert [n[0] for n in nodes] == ["[document]", "p", "p"]
    assert nodes[2][1] == 1          # second p is a child of the first
    assert nodes[1][3:] == (0, 3)    # first p holds a, b and c


def test_void_tags_close_and_stray_end_tag_ignored():
    text, nodes = tree("<div><img src=x><br></br>t</div>")
    tags = [n[0] for n in nodes]
    assert tags == ["[document]", "div", "img", "br"]
    assert nodes[2][2] == 2 and nodes[3][2] == 3  # no children
    assert text == "t"


def test_unmatched_end_tag_is_ignored():
    text, nodes = tree("<div>a</span>b</div>")
    assert text == "ab" and len(nodes) == 2


def test_end_tag_pops_to_nearest_open_match():
    _, nodes = tree("<div><span><b>x</div>y")
    # </div> closes b, span and div; y lands in the root
    assert all(n[2] == 3 for n in nodes[1:2])
    assert nodes[1][4] == 1


def test_hidden_strings_and_comments_not_in_text():
    text, _ = tree('<!DOCTYPE html><head><style>p{}</style><script>var t="</p>";</script></head>'
                   "<body>a<!-- c -->b<template>t</template><ruby>r<rt>x</rt></ruby></body>")
    assert text == "abr"


def test_whitespace_only_strings_collapse():
    text, _ = tree("<p>a</p>\n   \n<p>b</p>  <p>c</p><pre>  </pre>")
    assert text == "a\nb c  "


def test_repeated_attribute_keeps_last_and_none_is_empty():
    _, b = parse_document('<img src="a" src="b" hidden>')
    assert b.attrs[1] == {"src": "b", "hidden": ""}


def test_entities_decoded_in_text_and_attributes():
    text, b = parse_document('<a href="x?a=1&amp;b=2">&copy; &amp; &quot;</a>')
    assert text == '© & "'
    assert b.attrs[1]["href"] == "x?a=1&b=2"


def test_self_closing_after_void_quirk():
    # a <br> followed by <br/>: the second stays open (the end event is consumed)
    _, nodes = tree("<div><br><br/>x</div>")
    assert nodes[3][0] == "br" and nodes[3][4] == 1


def test_references_are_resolved_by_the_builder():
    text, _ = parse_document("<p>&notit; &bogus; &copy &#65; &#x42; &#150; &#x110000; a&b</p>")
    assert text == "&notit &bogus © A B – \ufffd a&b"


def test_end_tags_of_many_void_elements_take_linear_time():
    import time
    start = time.time()
    parse_document("<p><br></p>" * 40_000)
    assert time.time() - start < 20


def test_output_batches_stay_small_however_many_rows_an_input_batch_has():
    import pyarrow as pa
    from pagemill.operators.dom import _parse_batches
    n, nodes = 3000, 41  # the root and the elements of a page
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(n)), "html": ["<p>a</p>" * (nodes - 1)] * n})
    out = list(_parse_batches(["page_id"], "html")([batch]))
    assert [i for b in out for i in b.column("page_id").to_pylist()] == list(range(n))
    assert max(len(b.column("nodes").flatten()) for b in out) < 25_000
