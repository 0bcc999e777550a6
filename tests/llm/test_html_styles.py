"""The cascade of the layout renderer, by hand and against a plain one over random pages."""

import random
import time

from chronoset.llm import html as H


def test_what_a_browser_shows():
    for page, text in {
        "<style>.m{display:none}</style><p class=m style='display:block'>seen": "seen",
        "<style>.m{display:none} .m{display:block}</style><p class=m>seen": "seen",
        "<style>.m{display:none;display:inline}</style><p class=m>seen": "seen",
        "<p class=m>no</p>x<style>.m{display:none}</style>": "x",
        "<style>.m{display:none !important}</style><p class=m style='display:block'>no</p>x": "x",
        "<style>#a{display:block}.m{display:none}</style><p class=m id=a>seen": "seen",
        "<style>.w .m{display:block}.m{display:none}</style><div class=w><p class=m>seen</p></div><p class=m>no": "seen",
        "<style>.w>.m{display:none}</style><div class=w><p class=m>no</p><div><p class=m>seen": "seen",
        "<style>p:first-child{display:none}</style><p>seen": "seen",
        "<style>.m{display:none} .m:hover{display:block}</style><p class=m>no</p>x": "x",
        "<style>.m{display:none} .m:not(.z){display:block}</style><p class=m>seen": "seen",
        "<style>.m{display:none} i + .m{display:block}</style><p class=m>seen": "seen",
        "<style>@media print{.y{display:none}} @media screen and (max-width: 600px){.z{display:none}} @media (min-width:600px){.x{display:none}}</style><p class=y>y<p class=z>z<p class=x>x": "y\n\nz",
        "<style>@supports (color: red){.m{display:none}}</style><p class=m>seen": "seen",
        "<style>.m{color:red;& .q{display:none} top:0} .n{visibility:hidden;</style><p class=m>a<b class=q>b</b></p><p class=n>no": "ab",
        "<style>[data-x=a]{display:none}</style><p hidden style='display:block'>s</p><p data-x=a>no": "s",
        "<p hidden>no</p><p hidden style='display:revert'>no</p>x": "x",
        "<style media=print>p{display:none}</style><p>s": "s",
        "<template><style>p{display:none}</style></template><p>s": "s",
        "<style>p{display:foo}</style><p style='--display: none; x-display:none; display: var(--d)'>s": "s",
        "<style>/* } */ @import 'x;y'; a::before{content:'}'} p{display:none}</style><p>no</p>x": "x",
        "<style>*{visibility:hidden} b{visibility:visible}</style><p>no<b>yes": "yes",
    }.items():
        assert H.render(page) == text, page


def plain_cascade(tree, rules):
    """The words that are seen: every rule is matched at every element by looking at all its ancestors."""
    seen = []

    def fits(part, e):
        return (not part[0] or part[0] == e["tag"]) and all(c in e["class"] for c in part[1]) and (not part[2] or part[2] == e["id"])

    def matches(parts, path):
        if not fits(parts[-1][1], path[-1]):
            return False
        if len(parts) == 1:
            return True
        if parts[-1][0] == ">":
            return len(path) > 1 and matches(parts[:-1], path[:-1])
        return any(matches(parts[:-1], path[:k]) for k in range(1, len(path)))

    def walk(e, path, gone, hidden):
        path = [*path, e]
        best = {}
        for order, (parts, name, value, important) in enumerate(rules):
            if matches(parts, path):
                weight = (sum(bool(p[2]) for _, p in parts), sum(len(p[1]) for _, p in parts), sum(bool(p[0]) for _, p in parts))
                best[name] = max(best.get(name, ()), (important, False, weight, order, value))
        for name, value, important in e["style"]:
            best[name] = max(best.get(name, ()), (important, True, (0, 0, 0), 0, value))
        gone = gone or best.get("display", ("block",))[-1] == "none"
        hidden = {"hidden": True, "visible": False}.get(best.get("visibility", ("",))[-1], hidden)
        for child in e["children"]:
            if isinstance(child, str):
                if not gone and not hidden:
                    seen.append(child)
            else:
                walk(child, path, gone, hidden)

    for e in tree:
        walk(e, [], False, False)
    return seen


def test_random_pages_against_a_plain_cascade():
    r = random.Random(31)
    tags, classes, ids = ("div", "span", "section", "b"), ("u", "v", "w"), ("i", "j")
    n = 0

    def declaration():
        name = r.choice(("display", "visibility"))
        return name, r.choice(("none", "block", "inline") if name == "display" else ("hidden", "visible")), r.random() < 0.2

    def part():
        while True:
            p = (r.choice(("", *tags)), r.sample(classes, r.choice((0, 0, 1, 1, 2))), r.choice(("", "", "", *ids)))
            if p[0] or p[1] or p[2]:
                return p

    def element(depth):
        nonlocal n
        e = {"tag": r.choice(tags), "class": r.sample(classes, r.choice((0, 1, 1, 2))), "id": r.choice(("", "", "", *ids)), "style": [declaration()] if r.random() < 0.15 else [], "children": []}
        for _ in range(r.randint(1, 4)):
            n += 1
            e["children"].append(f"w{n}" if depth > 3 or r.random() < 0.5 else element(depth + 1))
        return e

    def css(name, value, important):
        return f"{name}: {value}{r.choice((' !important', '!important')) if important else ''}"

    def text(e):
        style = ";".join(css(*d) for d in e["style"])
        inner = "".join(f" {c} " if isinstance(c, str) else text(c) for c in e["children"])
        return f"<{e['tag']} class='{' '.join(e['class'])}' id='{e['id']}' style='{style}'>{inner}</{e['tag']}>"

    hidden = 0
    for _ in range(300):
        tree = [element(0) for _ in range(3)]
        rules = [([(r.choice((" ", ">")), part()) for _ in range(r.choice((1, 1, 2, 3)))], *declaration()) for _ in range(r.randint(0, 8))]
        sheet = ""
        for parts, *how in rules:
            one = "".join((f" {mark} " if k else "") + (p[0] or ("*" if r.random() < 0.3 else "")) + "".join(f".{c}" for c in p[1]) + (f"#{p[2]}" if p[2] else "") for k, (mark, p) in enumerate(parts))
            sheet += f"{one} {{ color: red; {css(*how)} }}\n"
        page = "".join(map(text, tree))
        where = r.randint(0, 1)
        got = H.render(f"<style>{sheet}</style>{page}" if where else f"{page}<style>{sheet}</style>").split()
        want = plain_cascade(tree, rules)
        hidden += page.count(" w") - len(want)
        assert got == want, (sheet, page)
    assert hidden > 500


def test_time_follows_sheets_and_pages():
    pages = {
        "rules": "<style>" + "".join(f".a{i} p{{display:none}}" for i in range(20_000)) + "</style>" + "<p>x" * 50_000,
        "conditions": "<style>" + "".join(f"p[a{i}=b]{{display:none}}" for i in range(5000)) + "</style>" + "<p>x" * 20_000,
        "descent": "<style>" + "div div p{display:none}" * 20_000 + "</style>" + "<div>" * 3000 + "x" + "<p>y" * 3000,
        "nested": "<style>" + "a{" * 200_000 + "</style>x",
        "quotes": "<style>" + "\"'" * 200_000 + "</style>x",
        "long selector": "<style>" + "a " * 100_000 + "{display:none}</style>x",
    }
    for name, page in pages.items():
        began = time.process_time()
        assert "x" in H.render(page), name
        assert time.process_time() - began < 20, name
