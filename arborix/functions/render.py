"""Text output of matches: locations, snippets, sections and summaries. Plain Python, applied to rows at the sink."""

from __future__ import annotations

from dataclasses import dataclass

# Terminal codes of the styles.
STYLES = {"path": "\x1b[35m", "line": "\x1b[32m", "match": "\x1b[1m\x1b[31m", "dim": "\x1b[2m", "reset": "\x1b[0m"}


def color_choice(args: list[str]) -> str:
    """``auto``, ``always`` or ``never``; the last setting wins."""
    out, i = "auto", 0
    while i < len(args):
        a = args[i]
        value = a.split("=", 1)[1] if a.startswith("--color=") else args[i + 1] if a == "--color" and i + 1 < len(args) else None
        if value in ("always", "ansi"):
            out = "always"
        elif value in ("auto", "never"):
            out = value
        i += 1
    return out


@dataclass
class Colors:
    enabled: bool = False

    def paint(self, style: str, text: str) -> str:
        return f"{STYLES[style]}{text}{STYLES['reset']}" if self.enabled else text


def highlight(text: str, spans: list[tuple[int, int]], colors: Colors) -> str:
    """The line with its byte spans coloured; unchanged if any span does not fit the text."""
    if not colors.enabled:
        return text
    raw, out, at = text.encode(), [], 0
    try:
        for a, b in spans:
            if a < at or b < a or b > len(raw):
                return text
            out.append(raw[at:a].decode())
            out.append(colors.paint("match", raw[a:b].decode()))
            at = b
        out.append(raw[at:].decode())
    except UnicodeDecodeError:
        return text
    return "".join(out)


def location(file: str, function: str | None, line: int | None, colors: Colors) -> str:
    if function is None:
        return colors.paint("path", file)
    return f"{colors.paint('path', file)}:{function}:{colors.paint('line', str(line))}"


def caller_line(c, colors: Colors) -> str:
    tail = f"  (when {' && '.join(c['conditions'])})" if c["conditions"] else ""
    return location(c["file"], c["function"], c["line"], colors) + tail


def reference_line(r, colors: Colors) -> str:
    tail = f"  ({r['context']})" if r["context"] else ""
    return location(r["file"], r["function"], r["line"], colors) + tail


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def hidden_context(n_callers: int, n_references: int) -> str | None:
    """What a section leaves out beyond its limit."""
    parts = [plural(n, f"more {what}") for n, what in ((n_callers, "caller"), (n_references, "reference")) if n > 0]
    return f"{' and '.join(parts)} hidden" if parts else None


def hidden_test_callers(total: int, limit: int, has_primary: bool) -> str | None:
    if not total:
        return None
    if total > limit:
        return f"{plural(total - limit, 'more test caller')} hidden"
    if not has_primary:
        return f"Only test callers found ({plural(total, 'test caller')} hidden)"
    return f"{plural(total, 'test caller')} hidden"


def hidden_test_references(total: int, limit: int) -> str | None:
    if not total:
        return None
    if total > limit:
        return f"{plural(total - limit, 'more test reference')} hidden"
    return f"Only test references found ({plural(total, 'test reference')} hidden)"


def snippet(number: int, text: str, is_match: bool, width: int, colors: Colors, spans=()) -> str:
    mark = ":" if is_match else "-"
    body = highlight(text, list(spans), colors) if is_match else text
    return f"  {colors.paint('line', str(number).rjust(width))}{mark} {body}"


def render_block(head, lines: list, show_tests: bool, limit: int, colors: Colors | None = None, compact: bool = False) -> str:
    """One block. ``head``: the first match with its function and contexts (a mapping); ``lines``: (number, text, is_match, spans)."""
    colors = colors or Colors()
    show = show_tests or bool(head.get("node_is_test"))
    get = lambda k: list(head.get(k) or [])
    callers, tests, refs, test_refs = get("callers"), get("test_callers"), get("references"), get("test_references")
    n = {k: int(head.get(f"n_{k}") or 0) for k in ("callers", "test_callers", "references", "test_references")}
    title = location(head["path"], head.get("function"), head.get("function_line"), colors)
    width = max((len(str(x[0])) for x in lines), default=1)
    code = [snippet(a, t, m, width, colors, s) for a, t, m, s in lines]
    inside = head.get("function") is not None
    if compact:
        parts = []
        if inside:
            for name, rows, over, shown in (("callers", callers, n["callers"] - limit, True), ("test callers", tests, 0, show), ("references", refs, n["references"] - limit, True), ("test references", test_refs, 0, show)):
                if shown and rows:
                    items = ", ".join((caller_line if "caller" in name else reference_line)(r, colors) for r in rows)
                    parts.append(f"{name}: {items}" + (f", +{over}" if over > 0 else ""))
            hidden = (0 if show else len(tests)) + (0 if show else len(test_refs))
            if hidden:
                parts.append(f"{hidden} in tests hidden")
        return "\n".join([title + (f" [{'; '.join(parts)}]" if parts else ""), *code])
    out = [title, *code]
    if inside:
        for name, rows, fmt, shown in (("Called by", callers, caller_line, True), ("Called by tests", tests, caller_line, show), ("Referenced by", refs, reference_line, True), ("Referenced by tests", test_refs, reference_line, show)):
            if shown and rows:
                out.append(f"  {name}:")
                out += [f"    {fmt(r, colors)}" for r in rows]
        over = hidden_context(n["callers"] - limit, n["references"] - limit)
        notes = [over] if over else []
        if show:
            notes += [x for x in (f"{plural(n['test_callers'] - limit, 'more test caller')} hidden" if n["test_callers"] > limit else None,) if x]
        else:
            notes += [x for x in (hidden_test_callers(n["test_callers"], limit, bool(callers)), hidden_test_references(n["test_references"], limit)) if x]
        out += [f"  {colors.paint('dim', x)}" for x in notes]
    return "\n".join(out)
