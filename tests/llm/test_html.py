"""Names of wrappers that tell of a page's state, not of what stands beside its article."""

import time

import pytest

from photolake.llm.html import main_text

TEXT = "It was a long day, and the river was high, so nobody went to the town until the rain had stopped."
SIDE = "Buy this now, it is cheap."


@pytest.mark.parametrize("wrapper", ['class="content has-sidebar"', 'id="page" class="no-comments"', 'class="post share-enabled"', 'class="page-header-fixed"', 'class="widget"', 'class="layoutWithSidebar"', 'id="main-menu-open"'])
def test_wrappers_keep_their_article(wrapper):
    page = f"<html><body><div {wrapper}><div><p>{TEXT}</p><p>{TEXT}</p></div><div class='sidebar'><p>{SIDE}</p></div></div></body></html>"
    assert main_text(page) == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("name", ["ad", "ad-box", "top-banner", "commentList comments", "shareBar"])
def test_marked_parts_are_left_out(name):
    page = f"<html><body><div><p>{TEXT}</p><div class='{name}'><p>{SIDE}</p></div><p>{TEXT}</p></div></body></html>"
    assert main_text(page) == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("wrapper", ["content no-sidebar", "with-sidebar", "notice-board", "header-image-post", "related", "byline"])
def test_no_part_of_a_name_drops_text(wrapper):
    page = f"<html><body><article><p>{TEXT}</p><p>{TEXT}</p><div class='{wrapper}'><p>{SIDE}</p></div></article></body></html>"
    assert main_text(page) == f"{TEXT}\n{TEXT}\n{SIDE}"


@pytest.mark.parametrize("tag", ['<div title="foo>', "<div class='x>", '<div a="1" b=">', "<p x='>"])
def test_a_quote_without_end_leaves_no_markup(tag):
    assert main_text(f"{tag}<p>{TEXT.replace(chr(39), '')}</p>") == TEXT


def test_only_the_listed_kinds_are_left_out():
    inside = "<fieldset>one</fieldset><object>two</object><p>an <svg><text>three</text></svg> and <math><mi>four</mi></math></p><div hidden>five</div><map>six</map><div style='display:none'>seven</div>"
    page = f"<article><p>{TEXT}</p>{inside}<form>no</form><button>no</button><aside>no</aside></article>"
    assert main_text(page) == f"{TEXT}\none\ntwo\nan three and four\nfive\nsix\nseven"


def test_the_first_of_equal_containers_is_kept():
    page = f"<body><div><section><div><p>{TEXT}</p></div></section></div><div><section><div><p>{TEXT[::-1]}</p></div></section></div></body>"
    assert main_text(page).startswith(TEXT)


@pytest.mark.parametrize("part", ["<div><p>deep", "<div>", "<ul><li>x", "<dl><div><dd>y", "<table><tr><td>z", "<b>", "<div class='ad'>", "<p><table>"])
def test_depth_costs_no_more_than_length(part):
    began = time.perf_counter()
    main_text(f"<body>{part * 20_000}<p>{TEXT}</p>")
    assert time.perf_counter() - began < 5
