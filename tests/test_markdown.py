from docweave.parsing import markdown as md


def test_headings_sections_and_slugs():
    text = "intro\n\n# Setup\ntext\n\n## Setup\nmore\n\n# Setup-1\nx\n\nTitle `code` here\n=====\nend\n"
    got = md.parse(text)
    assert [(h["depth"], h["text"], h["slug"]) for h in got["headings"]] == [(1, "Setup", "setup"), (2, "Setup", "setup-1"), (1, "Setup-1", "setup-1-1"), (1, "Title code here", "title-code-here")]
    assert [(s["heading"], s["start_line"], s["end_line"]) for s in got["sections"]] == [(None, 1, 1), ("Setup", 3, 4), ("Setup", 6, 7), ("Setup-1", 9, 10), ("Title code here", 12, 14)]
    assert got["sections"][1]["content"] == "# Setup\ntext"


def test_nested_headings_and_code_are_no_sections():
    text = "> # Quoted\n\n- item\n\n```md\n# not a heading\n```\n\n    # indented\n\n# Real\n"
    got = md.parse(text)
    assert [h["text"] for h in got["headings"]] == ["Real"]
    assert [(c["language"], c["content"]) for c in got["code"]] == [("md", "# not a heading"), (None, "# indented")]


def test_links():
    text = "[a](x.md#y) ![no](i.png) [b](https://e.org/z) `[c](d)` <me@x.org> see https://auto.org/p. [m](mailto:q@r.s) [t](tel:1)\n"
    assert [(x["text"], x["target"], x["external"]) for x in md.parse(text)["links"]] == [
        ("a", "x.md#y", False), ("b", "https://e.org/z", True), ("me@x.org", "mailto:me@x.org", True), ("https://auto.org/p", "https://auto.org/p", True),
        ("m", "mailto:q@r.s", True), ("t", "tel:1", False),
    ]


def test_references_and_annotations():
    text = "Use `src/a.ts`, `Auth.login()`, `not a name` and `README.md`.\n\n<!-- docweave:documents src/a.ts#f -->\n<!-- docweave:other x -->\n\nText <!-- docweave:explains y -->\n"
    got = md.parse(text)
    assert [(r["raw"], r["kind"]) for r in got["references"]] == [("src/a.ts", "file-path"), ("Auth.login()", "symbol-like"), ("README.md", "file-path")]
    assert [(a["directive"], a["target"], a["well_formed"], a["line"]) for a in got["annotations"]] == [
        ("documents", "src/a.ts#f", True, 3), ("other", "x", False, 4), ("explains", "y", False, 6),
    ]
    assert md.parse("")["sections"] == []
