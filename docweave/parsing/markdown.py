"""Markdown structure by a line-oriented block scanner.

Finds root-level headings (ATX and Setext), sections, links, code blocks,
inline code and annotations with their lines. It covers the block structure
that decides those: fenced and indented code, HTML blocks, lists and quotes
(whose headings are not root-level) and paragraphs; it is no full renderer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)[^`]*$")
_CONTAINER = re.compile(r"^ {0,3}(?:>|[-*+](?:[ \t]|$)|\d{1,9}[.)](?:[ \t]|$))")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_LINK = re.compile(r"(?<!!)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_AUTO = re.compile(r"<((?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)|(?:[\w.+-]+@[\w-]+(?:\.[\w-]+)+))>|(?<![\w/(<\"'])((?:https?://|www\.)[^\s<]*[^\s<?!.,:*_~)'\"])")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_EXTERNAL = re.compile(r"^([a-z][a-z0-9+.-]*:)?//", re.I)
_FILE = re.compile(r"^[\w./-]+\.(ts|tsx|js|jsx|mjs|cjs|md|mdx|json)$", re.I | re.A)
_SYMBOL = re.compile(r"^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*(\(\))?$", re.A)


class Slugger:
    """Anchors of headings in order of appearance."""

    def __init__(self):
        self.taken: dict[str, int] = {}

    def slug(self, heading: str) -> str:
        kept = "".join(c for c in heading.lower() if c in "-_ " or unicodedata.category(c)[0] in "LNM")
        base = name = kept.replace(" ", "-")
        while name in self.taken:
            self.taken[base] += 1
            name = f"{base}-{self.taken[base]}"
        self.taken[name] = 0
        return name


def plain(text: str) -> str:
    """The text of inline Markdown."""
    text = _CODE.sub(lambda m: m[2].strip(), text)
    text = re.sub(r"!?\[([^\[\]]*)\]\([^()]*\)", r"\1", text)
    text = re.sub(r"(\*\*|__|\*|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text).strip()


def _blocks(lines: list[str]) -> list[tuple[str, int, int, object]]:
    """(kind, first line, last line, extra) of root-level blocks, from 1."""
    out, i, n = [], 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        start = i
        fence, atx = _FENCE.match(line), _ATX.match(line)
        if fence:
            mark, i = fence[1], i + 1
            close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            while i < n and not close.match(lines[i]):
                i += 1
            content = "\n".join(lines[start + 1 : i])
            i = min(i + 1, n)
            out.append(("code", start + 1, i, (fence[2] or None, content)))
        elif atx:
            i += 1
            out.append(("heading", start + 1, i, (len(atx[1]), plain(atx[2] or ""))))
        elif re.match(r"^(?: {4}|\t)", line):
            while i < n and (re.match(r"^(?: {4}|\t)", lines[i]) or not lines[i].strip()):
                i += 1
            while not lines[i - 1].strip():
                i -= 1
            content = "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[start:i])
            out.append(("code", start + 1, i, (None, content)))
        elif re.match(r"^ {0,3}<!--", line):
            while i < n and "-->" not in lines[i]:
                i += 1
            i = min(i + 1, n)
            out.append(("html", start + 1, i, "\n".join(lines[start:i])))
        elif re.match(r"^ {0,3}</?[A-Za-z][\w-]*(?:[\s/>]|$)", line):
            while i < n and lines[i].strip():
                i += 1
            out.append(("html", start + 1, i, "\n".join(lines[start:i])))
        elif _RULE.match(line):
            i += 1
            out.append(("rule", start + 1, i, None))
        elif _CONTAINER.match(line):
            i += 1
            while i < n and (lines[i].strip() or (i + 1 < n and re.match(r"^(?: {2,}|\t)", lines[i + 1]))):
                if _ATX.match(lines[i]) or _FENCE.match(lines[i]):
                    break
                i += 1
            out.append(("container", start + 1, i, None))
        else:
            i += 1
            while i < n and lines[i].strip():
                setext = _SETEXT.match(lines[i])
                if setext:
                    i += 1
                    out.append(("heading", start + 1, i, (1 if setext[1][0] == "=" else 2, plain(" ".join(x.strip() for x in lines[start : i - 1])))))
                    break
                if _ATX.match(lines[i]) or _FENCE.match(lines[i]) or _CONTAINER.match(lines[i]) or re.match(r"^ {0,3}<!--", lines[i]):
                    out.append(("paragraph", start + 1, i, None))
                    break
                i += 1
            else:
                out.append(("paragraph", start + 1, i, None))
    return out


def annotations_in(html: str, prefix: str) -> dict | None:
    m = re.search(rf"<!--\s*{re.escape(prefix)}:(\S+)\s+(.*?)\s*-->", html)
    if not m:
        return None
    issues = [] if m[1] == "documents" else [f'Unknown {prefix} directive "{m[1]}"']
    issues += [] if m[2] else ["Annotation is missing a target"]
    return {"directive": m[1], "target": m[2], "well_formed": not issues, "issues": issues}


def parse(text: str, prefix: str = "docweave") -> dict:
    """Headings, sections, links, code blocks, symbol references, annotations."""
    lines = text.split("\n")
    blocks, slugger = _blocks(lines), Slugger()
    out = {k: [] for k in ("headings", "sections", "links", "code", "references", "annotations")}
    current, first, last = None, None, None

    def flush():
        if first is not None:
            content = "\n".join(lines[first - 1 : last])
            indent = len(content) - len(content.lstrip(" "))
            content = content[indent if indent < 4 else 0 :]
            out["sections"].append(
                {"heading": current and current["text"], "slug": current and current["slug"], "start_line": first, "end_line": last, "content": content.rstrip(" \t")}
            )

    for kind, start, end, extra in blocks:
        if kind == "heading":
            flush()
            current = {"depth": extra[0], "text": extra[1], "slug": slugger.slug(extra[1]), "line": start}
            out["headings"].append(current)
            first = start
        first = start if first is None else first
        last = end
        if kind == "code":
            out["code"].append({"language": extra[0], "content": extra[1], "start_line": start})
            continue
        raw = "\n".join(lines[start - 1 : end])
        if kind == "html":
            found = annotations_in(extra, prefix)
            if found:
                out["annotations"].append(found | {"line": start})
            continue
        for m in re.finditer(r"<!--.*?-->", raw, re.S):
            found = annotations_in(m[0], prefix)
            if found:
                out["annotations"].append(found | {"line": start + raw.count("\n", 0, m.start())})
        for m in _CODE.finditer(raw):
            name = m[2].strip()
            what = "file-path" if "/" in name or _FILE.match(name) else "symbol-like" if _SYMBOL.match(name) else None
            if what:
                out["references"].append({"raw": name, "kind": what, "line": start + raw.count("\n", 0, m.start())})
        bare = _CODE.sub(lambda m: " " * len(m[0]), raw)
        spans = []
        for m in _LINK.finditer(bare):
            target = m[2] if m[2] is not None else m[3]
            out["links"].append((m.start(), plain(raw[m.start(1) : m.end(1)]), target, start))
            spans.append(m.span())
        for m in _AUTO.finditer(bare):
            if any(a <= m.start() < b for a, b in spans):
                continue
            shown = m[1] or m[2]
            target = f"mailto:{shown}" if m[1] and "@" in shown and ":" not in shown else f"http://{shown}" if shown.startswith("www.") else shown
            out["links"].append((m.start(), shown, target, start))
        found = sorted(x for x in out["links"] if isinstance(x, tuple))
        out["links"] = [x for x in out["links"] if not isinstance(x, tuple)] + [
            {"text": t, "target": u, "external": bool(_EXTERNAL.match(u)) or u.startswith("mailto:"), "line": s + raw.count("\n", 0, p)} for p, t, u, s in found
        ]
    flush()
    return out


SCHEMA = (
    "path string, headings array<struct<depth:int,text:string,slug:string,line:int>>, "
    "sections array<struct<heading:string,slug:string,start_line:int,end_line:int,content:string>>, "
    "links array<struct<text:string,target:string,external:boolean,line:int>>, code array<struct<language:string,content:string,start_line:int>>, "
    "references array<struct<raw:string,kind:string,line:int>>, "
    "annotations array<struct<directive:string,target:string,well_formed:boolean,issues:array<string>,line:int>>"
)


def parse_files(files: DataFrame, prefix: str = "docweave") -> DataFrame:
    """One row with six arrays for each of files(path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "headings", "sections", "links", "code", "references", "annotations"]
        for frame in frames:
            yield pd.DataFrame([{"path": p} | parse(t or "", prefix) for p, t in zip(frame.path, frame.content, strict=True)], columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
