"""What a page shows: spans, visibility, sheets, forms; tables against a brute-force grid."""

import random
import re

from glyphmill.llm import html


def show(page):
    return html.render(page)[0]


def test_cells_over_rows_keep_their_columns():
    assert show("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>") == "A | b\n  | c"
    assert show("<table><tr><td>a<td rowspan=0>B<tr><td>c<tr><td>d<td>e</table>") == "a | B\nc\nd |   | e"
    assert show("<table><tr><td>中文<td>x<tr><td>ab<td>y</table>") == "中文 | x\nab   | y"


def test_visibility_can_come_back():
    assert show("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</div>") == "yes"
    assert show("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>") == "- yes"
    assert show("<p style='display:none'>no <b style='visibility:visible;display:block'>no</b>") == ""
    assert show("<p style='display:none;display:block'>yes") == "yes"
    assert html.render("<ul style='visibility:hidden'><li>no</ul>")[1:] == (0, 0, 0)


def test_style_sheets():
    sheet = "<style>/* .b{display:none} */ @media print { .b {display:none} } .h, p#x {display:none} q.v{visibility:hidden} a b{display:none}</style>"
    assert show(sheet + "<b class=b>1</b> <i class='a h'>no</i> <p id=y>2</p><p id=x>no</p><q class=v>no</q><a>3 <b>4</b></a>") == "1\n\n2\n\n3 4"
    assert show("<style>.h{display:none} #k{display:block}</style><b class=h id=k>1</b><b class=h style='display:inline'>2</b>") == "12"
    assert show("<style>.h{display:none!important}</style><b class=h style='display:inline'>no</b>") == ""
    media = " @media print{.a{display:none}.b{display:none}} @font-face{src:x} .h{display:none}"
    assert show(f"<style>{media}</style><b class=a>1</b><b class=b>2</b><b class=h>no</b>") == "12"
    for broken in ("<style>}}{{;.h{display:none", "<style>@media", "<style>@import 'x';.h{display:none}", "<style>{"):
        assert show(broken + "</style>ok<b class=h></b>") == "ok"


def test_forms_and_details():
    assert show("<input value=a> <input type=hidden value=no> <input type=password value=no>") == "a"
    assert show("x <select><option>a<option selected>b<option>c</select> y") == "x b y"
    assert show("<select><option disabled>a<option>b</select>") == "b"
    assert show("<select multiple><option>a<option>b</select>") == "a\nb"
    assert show("<select><option>a<select><option>b</select>z") == "a b z"
    assert show("<details>no<summary>yes</summary>no<p>no</p><summary>no</summary></details>z") == "yes\nz"
    assert show("<details open><summary>yes</summary>all</details>") == "yes\nall"
    assert show("<table><tr><td><select><option>a<option>b<td>c</table>") == "a | c"


def test_tables_against_a_grid():
    rng = random.Random(3)
    for _ in range(300):
        rows = [[(f"w{rng.randrange(10 ** rng.randrange(1, 5))}", rng.randrange(1, 4)) for _ in range(rng.randrange(1, 5))] for _ in range(5)]
        page = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d}>{w}" for w, d in row) for row in rows) + "</table>"
        cells, full = {}, set()
        for r, row in enumerate(rows):
            c = 0
            for word, down in row:
                while (r, c) in full:
                    c += 1
                cells[r, c] = word
                full |= {(r + k, c) for k in range(down)}
        wide = {c: max(len(w) for (_, k), w in cells.items() if k == c) for _, c in cells}
        want = [
            " | ".join(cells.get((r, c), "").ljust(wide[c]) for c in range(max(k for q, k in cells if q == r) + 1)).rstrip()
            for r in range(5)
        ]
        assert [re.sub(r" +$", "", line) for line in show(page).split("\n")] == want
