"""Property tests: tree invariants of the parse on random markup."""

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.operators.dom import ROOT_TAG, parse_document

TAGS = ["p", "div", "span", "img", "br", "script", "style", "a", "h1", "main", "ul", "li", "template", "pre"]
piece = st.one_of(
    st.sampled_from(TAGS).map(lambda t: f"<{t}>"),
    st.sampled_from(TAGS).map(lambda t: f"</{t}>"),
    st.sampled_from(TAGS).map(lambda t: f"<{t}/>"),
    st.sampled_from(["<!-- c -->", "<!DOCTYPE html>", "&amp;", "&copy;", " ", "\n", "\t"]),
    st.text(alphabet="abcxyz <>&;\n", min_size=0, max_size=8),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(piece, max_size=40))
def test_tree_invariants(parts):
    html = "".join(parts)
    text, b = parse_document(html)
    n = len(b.tags)
    assert b.tags[0] == ROOT_TAG and b.parent[0] == -1
    assert b.starts[0] == 0 and b.ends[0] == len(text) and b.last[0] == n - 1
    for i in range(1, n):
        p = b.parent[i]
        assert 0 <= p < i                                  # pre-order: parent first
        assert i <= b.last[i] <= b.last[p]                 # subtree nested in parent's
        assert b.starts[p] <= b.starts[i] <= b.ends[i] <= b.ends[p]
    for i in range(1, n):                                  # siblings do not overlap
        j = b.last[i] + 1
        if j < n and b.parent[j] == b.parent[i]:
            assert b.ends[i] <= b.starts[j]
