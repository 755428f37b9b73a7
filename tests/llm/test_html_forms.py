"""Forms and dialogs that hold the page, and those that don't; a heading in a header."""

import duckdb
import pytest

from pagewright.llm import html_density

SF = "/root/testdata/sf0.01/pages.parquet"


def pages():
    from pathlib import Path

    return [r[0] for r in duckdb.sql(f"select html from '{SF}{'/*.parquet' if Path(SF).is_dir() else ''}'").fetchall() if r[0]]


@pytest.mark.parametrize("wrap", ['<form method="post" action="./" id="aspnetForm">{}</form>', "<fieldset>{}</fieldset>", '<div role="form">{}</div>', "<dialog open>{}</dialog>", '<form><div role="dialog"><fieldset>{}</fieldset></div></form>'])
def test_a_form_around_the_page_changes_nothing(wrap):
    changed = 0
    for page in pages():
        begin = page.lower().find("<body")
        begin = page.find(">", begin) + 1
        end = page.lower().rfind("</body")
        end = len(page) if end < begin else end
        wrapped = page[:begin] + wrap.format(page[begin:end]) + page[end:]
        changed += html_density.extract(wrapped) != html_density.extract(page)
    assert changed == 0


P = "<p>" + "This is a plain sentence of an article, and it goes on for a while. " * 4 + "</p>"
TEXT = ("This is a plain sentence of an article, and it goes on for a while. " * 4).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><article><h1>Head</h1>{P}<form><p>Sign up for our letter</p><label>Mail</label><input><button>Go</button></form>{P}</article></body>", f"Head\n{TEXT}\n{TEXT}"),
        (f"<body><form role=search><p>Search this site</p><input></form><div>{P}{P}</div></body>", f"{TEXT}\n{TEXT}"),
        (f"<body><form id=f><input type=hidden><div><form role=search>Find</form></div><article>{P}</article><select><option>One</select></form></body>", TEXT),
        (f"<body><main>{P}</main><dialog><p>We use many cookies here</p></dialog><div role=dialog><p>Please log in now</p></div></body>", TEXT),
        ("<body><form><p>Log in</p><label>Name</label><input></form></body>", ""),
        (f"<head><title>The Long Way | Site</title></head><body><header><a href=/>Site</a><h1>The Long Way</h1><p>Slogan</p></header><article>{P}</article></body>", f"The Long Way\n{TEXT}"),
        (f"<head><title>The Long Way</title></head><body><header><h1>Our Site</h1></header><article>{P}</article></body>", TEXT),
        (f"<head><title>Our Site</title></head><body><header><h1><a href=/>Our Site</a></h1></header><article>{P}</article></body>", TEXT),
        (f"<head><title>Head - Our Site</title></head><body><header><h1>Our Site</h1></header><article><h1>Head</h1>{P}</article></body>", f"Head\n{TEXT}"),
    ],
)
def test_hand_marked(page, want):
    assert html_density.extract(page) == want
