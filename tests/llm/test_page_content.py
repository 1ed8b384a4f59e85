"""Page content that must reach the trees: formulas, drawings, fallback text, unclosed elements, pages without a body tag."""

import pytest

from vintage.llm import html_extract

BEFORE, AFTER = "First words, of the story here.", "Second words of it, and more of them."
MENU = "<body><nav><a href=/>Home</a></nav>"


@pytest.mark.parametrize(
    "inner, wanted",
    [
        ('See <svg class="i"/> two', "See two"),
        ("See <math/> two", "See two"),
        ('See <svg class="i"> two', "See two"),
        ("Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold", "Let x=1 hold"),
        ("See <svg><title>icon</title><path d='M0'/><text>axis</text></svg> two", "See axis two"),
        ("See <svg><style>p{}</style><script>no()</script></svg> two", "See two"),
        ("A <select><option>a</select> b", "A b"),
        ("A <template><p>no</p></template> b", "A b"),
        ("A <iframe src=x/> b", "A b"),
        ('A <script>s = "</style></svg>no";</script> b', "A b"),
    ],
)
def test_elements_end_by_their_own_name(inner, wanted):
    source = f"{MENU}<article><p>{BEFORE}</p><p>{inner}</p><p>{AFTER}</p></article><footer>c 2020</footer>"
    assert html_extract.trained().texts([source]) == [f"{BEFORE}\n{wanted}\n{AFTER}"]


@pytest.mark.parametrize("name", ["object", "noscript"])
def test_fallback_text_is_a_node(name):
    source = f"{MENU}<article><p>{BEFORE}</p><{name}><p>The story goes on here, as fallback text.</p></{name}><p>{AFTER}</p></article>"
    page = html_extract.parse(source)
    assert [(page.tag[n], t) for n, t in page.texts][-2] == ("p", "The story goes on here, as fallback text.") and name in page.tag
    assert html_extract.trained().texts([source]) == [f"{BEFORE}\nThe story goes on here, as fallback text.\n{AFTER}"]


def test_unclosed_controls_do_not_take_the_rest():
    page = html_extract.parse("<p>one<p><select><option>a<p>two")
    assert [t for _, t in page.texts][-1] == "two"


@pytest.mark.parametrize("source", ["words of a story", "<title>t</title>words of a story", "<html><head><meta charset=x></head>words of a story", "<body></body>words of a story"])
def test_text_outside_elements_is_in_the_body(source):
    page = html_extract.parse(source)
    assert [(page.tag[n], t) for n, t in page.texts] == [("body", "words of a story")] and page.tag.count("body") == 1
