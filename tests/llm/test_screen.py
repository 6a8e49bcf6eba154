"""Style rules of other media, later rules, and text that stands directly in tables."""

import pytest

from lodestar.llm.html_text import visible_text

PAGES = [
    ("<style>@media (max-width:600px){.s{display:none}} @media print{.s{display:none}}</style><p class=s>yes", "yes"),
    ("<style>@media screen and (max-width:9px){p{color:red}.s{display:none}} .t{display:none}</style><p class=s>yes<p class=t>no", "yes"),
    ("<style>@media screen{.s{display:none}} @media all, print{.t{display:none}}</style><p class=s>no<p class=t>no<p>yes", "yes"),
    ("<style media=print>.s{display:none}</style><p class=s>yes", "yes"),
    ("<style>.tab{display:none} .tab{display:block}</style><p class=tab>yes", "yes"),
    ("<style>.tab{display:block}</style><div><style>.tab{display:none}</style></div><p class=tab>no<p>yes", "yes"),
    ("<style>.tab{display:none !important} .tab{display:block}</style><p class=tab>no<p>yes", "yes"),
    ("<style>@import 'x'; /* .a{ */ @font-face{src:x} @keyframes k{from{display:none}} .s{color:red;display:none}</style><p class=s>no<p>yes", "yes"),
    ("<style>@supports (display:grid){@media print{.s{display:none}} .t{display:none}}</style><p class=s>yes<p class=t>no", "yes"),
    ("<table><tr>stray<td>1<td>2</table>", "stray\n1 | 2"),
    ("<table><tbody>one <tr><td>1</tbody><tfoot>two</tfoot></table>", "one two\n1"),
    ("<table><tr hidden>no<td>no<tr><td>1</table>", "1"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_screen(page, text):
    assert visible_text(page) == text


def test_long_sheets():
    assert visible_text("<style>" + "@media print{" * 3000 + ".a{" * 3000 + "</style>x") == "x"
    assert visible_text("<style>" + "a" * 300_000 + "</style>x") == "x"
    assert visible_text("<style>" + "{" * 300_000 + "</style>x") == "x"
    assert visible_text("<style>.s{display:none</style><p class=s>no<p>x") == "x"
