"""Pages whose text must reach the field: only what is really hidden is left out before."""

import pytest

from wordvane.llm import html_extract

TEXT = "One two three four five six."


def seen(page):
    return [b.text for b in html_extract.blocks(page)]


@pytest.mark.parametrize("attributes", [
    'style="overflow:hidden"', 'title="The hidden valley"', 'class="hidden md:block"', "class=hidden", 'data-x="display:none"', 'aria-hidden="true"', 'data-hidden="1"',
    'style="--display:none"', 'style="display:none; display:block"', 'style="/* display:none */ color:red"', 'title="style=display:none"',
])
def test_shown(attributes):
    assert seen(f"<body><article {attributes}><p>{TEXT}</p></article></body>") == [TEXT]
    assert html_extract.main_text(f"<body><article {attributes}><p>{TEXT}</p><p>{TEXT}</p></article></body>", html_extract.trained()) == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("attributes", ["hidden", 'class=x hidden=""', "HIDDEN id=a", "hidden='until-found'", 'style="display:none"', "style=display:none", "STYLE='color:red; Display : NONE !important; display:block'", 'style="display&#58;none"'])
def test_not_shown(attributes):
    assert seen(f"<body><div {attributes}><p>secret</p></div><p>{TEXT}</p></body>") == [TEXT]


@pytest.mark.parametrize("page", [
    f"<head><title>x</title><body><article><p>{TEXT}</p></article></body>", f"<html><head><title>x</title><article><p>{TEXT}</p></article>", f"<head><meta charset=utf-8><title>x</title>{TEXT}",
    f"<head><title>x</title><style>p {{}}</style></head><body><p>{TEXT}</p></body>", f"<head><script>var a</script><body><p>{TEXT}</p></head></body>",
])
def test_head_ends(page):
    assert seen(page) == [TEXT]


def test_math_is_text():
    page = "<article><p>Here <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> holds for all of the numbers.</p></article>"
    assert seen(page) == ["Here x=2 holds for all of the numbers."]
