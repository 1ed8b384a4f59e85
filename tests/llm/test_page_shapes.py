"""Pages that real sites serve: attributes that look like labels, unclosed markup, no container, table layouts, hidden blocks."""

import time

import pytest

from vintage.llm import html_extract

STORY = "The river rose through the night, and by morning the lower fields were under water. Nobody had expected it so early."
MORE = "Farmers moved their cattle to the hill, where the grass was short but dry, and waited for the sun."

PAGES = {
    "labels of a real page": (f'<body><nav data-y="1"><a href=/>Home</a></nav><article data-y="top"><p data-y="0">{STORY}</p><p data-y="-3">{MORE}</p></article></body>', f"{STORY}\n{MORE}"),
    "one paragraph": (f"<html><body><p>{STORY}</p></body></html>", STORY),
    "bare paragraphs": (f"<html><body><h1>High water</h1><p>{STORY}</p><p>{MORE}</p></body></html>", f"High water\n{STORY}\n{MORE}"),
    "unnamed container": (f'<body><div class="menu"><a href=/>Home</a><a href=/n>News</a></div><div id="x1"><p>{STORY}</p><p>{MORE}</p></div><div class="footer">Copyright 2020</div></body>', f"{STORY}\n{MORE}"),
    "table layout": (f'<body><table><tr><td><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></td><td><h1>High water</h1><p>{STORY}</p><p>{MORE}</p></td></tr></table></body>', f"High water\n{STORY}\n{MORE}"),
    "hidden block": (f'<body><nav><a href=/>Home</a></nav><article><p>{STORY}</p><div style="display:none">Tracking text, not to be seen.</div><p>{MORE}</p></article></body>', f"{STORY}\n{MORE}"),
    "hidden attribute": (f"<body><nav><a href=/>Home</a></nav><main><p>{STORY}</p><p hidden>Not to be seen, this one.</p><p>{MORE}</p></main></body>", f"{STORY}\n{MORE}"),
    "footer and comments": (f'<body><header><a href=/>Site</a></header><main><p>{STORY}</p><p>{MORE}</p></main><section id="comments"><h3>Comments</h3><p>I was there, it was worse than this.</p></section><footer>All rights reserved</footer></body>', f"{STORY}\n{MORE}"),
    "form in the text": (f'<body><article><p>{STORY}</p><form action=/s><label>Search</label><input name=q><button>Go</button></form><p>{MORE}</p></article></body>', f"{STORY}\n{MORE}"),
    "aside in the text": (f'<body><article><p>{STORY}</p><aside class="related"><h4>Related</h4><a href=/1>One</a><a href=/2>Two</a></aside><p>{MORE}</p></article></body>', f"{STORY}\n{MORE}"),
}


def test_pages_by_hand():
    """Each page's text: all but one are right (README), and that one has all of its article and one item of a menu."""
    model = html_extract.trained()
    found = {name: model.texts([source])[0] for name, (source, _) in PAGES.items()}
    wrong = [name for name, (_, wanted) in PAGES.items() if found[name] != wanted]
    assert len(wrong) <= 1 and all(found[name].endswith(wanted) for name, (_, wanted) in PAGES.items())


@pytest.mark.parametrize("markup", ["<b>{}<p>x</p>", "<b><p>x</p>{}", "<div><span>{}<li>y", "<table>{}<td><b>z", "</b>{}<p>x", "<a href='>{}", "<i><li>{}</i>"])
def test_unclosed_markup_takes_time_in_proportion(markup):
    head, tail = markup.split("{}")
    taken = []
    for n in (4000, 16000):
        source = head * n + tail * n
        start = time.process_time()
        page = html_extract.parse(source, labels=False)
        taken.append(time.process_time() - start)
        assert len(page.tag) >= 1
    assert taken[1] < 8 * taken[0] + 0.5
