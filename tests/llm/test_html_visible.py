"""Markup whose visible text was lost or whose hidden text was shown."""

import pytest

from marketframe.llm import html_text

CASES = {
    "<table><thead><th>Name<th>Value</thead><tbody><tr><td>a<td>1</table>": "Name  Value\na     1",
    "<table><td>a<td>b</table>": "a  b",
    "<table><tbody>stray<tr><td>a</table>": "stray\na",
    "<table><tr><td>a</tr><td>b</table>": "a\nb",
    "<table><colgroup><col><td>a</table>": "a",
    "<table><tfoot><b>x</b></tfoot></table>": "x",
    "a <svg><title>t</title><defs><text>no</text></defs><rect/><text>one</text><text>two</text></svg> b": "a one two b",
    "<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math>": "x=2",
    "<object data=a.swf><param name=a><p>instead</p></object>": "instead",
    "<p aria-hidden=true>drawn</p>": "drawn",
    "<svg><defs/><text>kept</text></svg>": "kept",
    "<select><option>A<option>B</select>": "A",
    "<select><option>A<option selected>B<option>C</select> x": "B x",
    "<select multiple><optgroup label=g><option>A<option>B</select>": "A B",
    "<table><tr><th rowspan=2>a<th>b<th>c<tr><td>d<td>e</table>": "a  b  c\n   d  e",
    "<table><tr><td colspan=2>wide cell<td>x<tr><td>1<td>2<td>3</table>": "wide cell  x\n1  2       3",
    "<table><tr><td rowspan=3>a<td>b<tr><td>c<tr><td>d<tr><td>e<td>f</table>": "a  b\n   c\n   d\ne  f",
    "<table><tfoot><tr><td>foot</tfoot><tbody><tr><td>body</tbody><thead><tr><td>head</thead></table>": "head\nbody\nfoot",
    "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>": "yes",
    "<p style='display:none;display:block'>shown</p>": "shown",
    "<p style='display:block;display:none'>gone</p>x": "x",
    "<progress value=3>fallback</progress><meter>fallback</meter>x": "x",
    "<input type=submit value=Go><input type=hidden value=h><input type=checkbox value=c>": "Go",
    "<input value=typed> <input placeholder='Your name'><button>Send</button>": "typed Your name Send",
    "<ol><li value=4>a<li>b</ol>": "4. a\n5. b",
    "<ol reversed><li>a<li>b<li>c</ol>": "3. a\n2. b\n1. c",
    "<details><summary>More</summary><p>inside</details>": "More",
    "<details open><summary>More</summary><p>inside</details>": "More\n\ninside",
    "<style>.x, #y.z{display:none} b{visibility:hidden}</style><p class='a x'>no</p><p id=y>kept</p><p id=y class=z>no</p><b>no</b>": "kept",
    "<style>p{display:none} p.on{display:block}</style><p>no</p><p class=on>yes</p>": "yes",
    "<style>@media print{p{display:none}} i{display:none}</style><p>yes</p><i>no</i>": "yes",
    "<style>/* p{display:none} */ div p{display:none}</style><p>yes</p>": "yes",
    "<p hidden style='display:block'>shown</p>": "shown",
}


@pytest.mark.parametrize("html", CASES)
def test_visible(html):
    assert html_text.extract(html) == CASES[html]


def test_any_depth():
    deep = "<div>" * 300
    assert html_text.extract(deep + "<div style='display:none'><b>no</b></div><p>a<p>b") == "a\n\nb"
    assert html_text.extract("<table><tr><td>" * 2000 + "x") == "x"
    assert html_text.extract("<div>" * 50_000 + "<i hidden>no</i>x") == "x"
