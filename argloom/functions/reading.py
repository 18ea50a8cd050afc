"""Small readers of single texts: data in braces, elements of xml, argument maps and reconstructions. Everything decided about what they find are columns."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from textwrap import shorten as _shorten
from typing import NamedTuple

_SCALAR = re.compile(r"[^,\[\]{}\n]*")
_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^']|'')*)'")
_KEY = re.compile(r"([^,\[\]{}:\"'\n]+?)\s*:(?=[\s\[{\"']|$)")
#: Plain scalars of YAML 1.1.
_WORDS = {x: v for v, words in ((True, "true yes on"), (False, "false no off")) for w in words.split() for x in (w, w.title(), w.upper())} | {"null": None, "Null": None, "NULL": None, "~": None, "": None}
_INT = re.compile(r"([-+]?)(?:0b([01_]+)|0x([0-9a-fA-F_]+)|(0[0-7_]*)|([1-9][0-9_]*)|([1-9][0-9_]*(?::[0-5]?[0-9])+))")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*(?:[eE][-+][0-9]+)?|\.[0-9][0-9_]*(?:[eE][-+][0-9]+)?|\.(?:inf|Inf|INF))|\.(?:nan|NaN|NAN)")


def _scalar(text: str):
    """A plain scalar by its form: yes and no are truth values, 010 is eight, 1_000 a thousand, 1:30 ninety, nan and 1e3 are text."""
    text = text.strip()
    if text in _WORDS:
        return _WORDS[text]
    if m := _INT.fullmatch(text):
        sign, *forms = m.groups()
        base, digits = next((b, d) for b, d in zip((2, 16, 8, 10, 60), forms, strict=True) if d is not None)
        digits = digits.replace("_", "")
        value = 0
        for part in digits.split(":") if base == 60 else ():
            value = 60 * value + int(part)
        return (-1 if sign == "-" else 1) * (value if base == 60 else int(digits or "0", base))
    if _FLOAT.fullmatch(text):
        return float(text.replace("_", "").lower().replace(".inf", "inf").replace(".nan", "nan"))
    return text


class _Flow:
    """Data in flow style: maps, lists, quoted and plain scalars."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
            self.at += 1

    def take(self, mark: str) -> bool:
        self.space()
        found = self.text.startswith(mark, self.at)
        self.at += len(mark) * found
        return found

    def quoted(self) -> str | None:
        m = _QUOTED.match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2].replace("''", "'")

    def key(self) -> str:
        self.space()
        found = self.quoted()
        if found is not None:
            if not self.take(":"):
                raise ValueError("a key without value")
            return found
        m = _KEY.match(self.text, self.at)
        if not m:
            raise ValueError("a key is missing")
        self.at = m.end()
        return str(_scalar(m[1]))

    def pairs(self, end: str) -> dict:
        out = {}
        while not self.take(end):
            key = self.key()
            out[key] = self.value()
            if not self.take(","):
                if not self.take(end):
                    raise ValueError("a map is not closed")
                break
        return out

    def value(self):
        self.space()
        if self.take("{"):
            return self.pairs("}")
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.value())
                if not self.take(","):
                    if not self.take("]"):
                        raise ValueError("a list is not closed")
                    break
            return out
        found = self.quoted()
        if found is not None:
            return found
        m = _SCALAR.match(self.text, self.at)
        if m.end() == self.at and self.text[self.at : self.at + 1] not in (",", "}", "]", ""):
            raise ValueError("no value")
        self.at = m.end()
        return _scalar(m[0])


def data(text: str):
    """What a text of data holds; ValueError if it can't be read to its end."""
    flow = _Flow(text.strip())
    if not flow.text:
        return None
    if flow.text[0] not in "{[\"'" and _KEY.match(flow.text):
        out = {}
        key = flow.key()  # a map of one line without braces
        out[key] = flow.value()
    else:
        out = flow.value()
    flow.space()
    if flow.at < len(flow.text):
        raise ValueError("more than one value")
    return out


@lru_cache(4096)
def header(line: str) -> tuple[str, dict[str, str]]:
    """(kind of what a fence's first line says: dict, list, scalar or null; the pairs of a dict)."""
    try:
        found = data(line.replace("=", ": "))
    except ValueError:
        found = None
    kind = "dict" if isinstance(found, dict) else "list" if isinstance(found, list) else "null" if found is None else "scalar"
    return kind, {k: str(v) for k, v in found.items()} if kind == "dict" else {}


def shorten(text: str, width: int) -> str:
    """textwrap.shorten(), without its patterns where words have no hyphens."""
    text = " ".join(text.split())
    if len(text) <= width:
        return text
    if "-" in text or width < 7:
        return _shorten(text, width)
    end = text.rfind(" ", 0, width - 5)
    return text[:end] + " [...]" if end > 0 else "[...]"


#: Tags that nothing has to be guessed about: whole names, quoted values without entities.
_TAG = re.compile(r'<(?:/([a-zA-Z][a-zA-Z0-9]*)|([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z_][a-zA-Z0-9_]*="[^"<>&]*")*))>')
_PAIR = re.compile(r' ([a-zA-Z_][a-zA-Z0-9_]*)="([^"]*)"')
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


def _plainly(body: str) -> tuple[list[dict], str] | None:
    """(elements, text) of a body that has only such tags, as the lenient reader gives them; None for others."""
    if "&" in body:
        return None
    found: list[dict] = []
    open_: list[int] = []
    texts: list[list[str]] = []
    starts: list[int] = []
    whole: list[str] = []
    at = 0

    def shut(first: int, end: int) -> None:
        for i in open_[first:]:
            shown = body[starts[i] : end]
            e = found[i]
            e["shown"], e["brief"], e["text"] = shorten(shown, 64), shorten(shown, 40), "".join(texts[i])
        del open_[first:]

    for m in _TAG.finditer(body):
        start, end = m.span()
        if start > at:
            said = body[at:start]
            if "<" in said:
                return None
            whole.append(said)
            for i in open_:
                texts[i].append(said)
        at = end
        closed, tag, rest = m.groups()
        if closed is not None:
            closed = closed.lower()
            for i in range(len(open_) - 1, -1, -1):
                if found[open_[i]]["name"] == closed:
                    shut(i, end)
                    break
            continue
        tag = tag.lower()
        if tag in _RAW:
            return None
        given = {k.lower(): v for k, v in _PAIR.findall(rest)} if rest else {}
        if tag == "proposition" and any(found[i]["name"] == tag for i in open_):
            for i in open_:
                found[i]["nested"] = True
        get = given.get
        found.append({
            "pos": len(found), "parent": open_[-1] if open_ else None, "depth": len(open_), "name": tag, "id": get("id"), "supports": get("supports", "").split(), "attacks": get("attacks", "").split(),
            "argument_label": get("argument_label"), "ref_reco_label": get("ref_reco_label"), "attributes": list(given), "nested": False,
        })
        texts.append([])
        starts.append(start)
        open_.append(len(found) - 1)
    said = body[at:]
    if "<" in said:
        return None
    if said:
        whole.append(said)
        for i in open_:
            texts[i].append(said)
    shut(0, len(body))
    return found, "".join(whole)


class _Elements(HTMLParser):
    """A lenient tree: a closing tag closes the nearest open element of its name, and what is open within."""

    def __init__(self, body: str):
        super().__init__()
        self.body, self.found, self.open = body, [], []
        self.lines = [0]
        for m in re.finditer("\n", body):
            self.lines.append(m.end())
        self.feed(body)
        self.close()
        self._shut(0, len(body))

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _shut(self, first: int, end: int) -> None:
        for i in self.open[first:]:
            shown = self.body[self.found[i].pop("start") : end]
            self.found[i] |= {"shown": shorten(shown, 64), "brief": shorten(shown, 40), "text": "".join(self.found[i]["text"])}
        del self.open[first:]

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        within = any(self.found[i]["name"] == "proposition" for i in self.open) and tag == "proposition"
        for i in self.open if within else ():
            self.found[i]["nested"] = True
        self.found.append({
            "pos": len(self.found), "parent": self.open[-1] if self.open else None, "depth": len(self.open), "name": tag, "id": given.get("id"),
            "supports": given.get("supports", "").split(), "attacks": given.get("attacks", "").split(), "argument_label": given.get("argument_label"),
            "ref_reco_label": given.get("ref_reco_label"), "attributes": list(given), "nested": False, "text": [], "start": self._place(),
        })
        self.open.append(len(self.found) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self._shut(len(self.open) - 1, self._place() + len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.found[self.open[i]]["name"] == tag:
                self._shut(i, self._place() + len(tag) + 3)
                return

    def handle_data(self, data):
        for i in self.open:
            self.found[i]["text"].append(data)


def elements(body: str) -> list[dict]:
    return annotation(body)[0]


class _Text(HTMLParser):
    def __init__(self, body: str):
        super().__init__()
        self.out = []
        self.feed(body)
        self.close()

    def handle_data(self, data):
        self.out.append(data)


def plain(body: str) -> str:
    """The text of html or xml without its tags."""
    return "".join(_Text(body).out)


def annotation(body: str) -> tuple[list[dict], str]:
    """(elements, text without tags) of html or xml, read once where nothing has to be guessed."""
    return _plainly(body) or (_Elements(body).found, plain(body))


_MULTI = re.compile(r"/\*.*?\*/|<!--.*?-->", re.S)
_COMMENT = re.compile(r"(?:^|\s)//.*")
_LINE = re.compile(r"( *)(?:(<\+|<-|\+>|->|><|\+|-|\*|[0-9]+\.)(?: +|$))?(.*)")
_STARTS = re.compile(r"\[|<|\([^()\s]+\)")
_NODE = re.compile(r"(?:\((?P<item>[^()]+)\) *)?(?:\[(?P<claim>[^\]]+)\]|<(?P<argument>[^<>]+)>)?(?P<colon> *:)? *(?P<text>.*)", re.S)
#: What the marks of relations mean; the last says whether the line's own node is the source.
_RELATIONS = {"+": ("SUPPORT", True), "<+": ("SUPPORT", True), "-": ("ATTACK", True), "<-": ("ATTACK", True), "+>": ("SUPPORT", False), "->": ("ATTACK", False), "><": ("CONTRADICT", False)}


#: Short data, which many items share; nobody changes what it gives.
_short_data = lru_cache(4096)(data)


def _with_data(text: str) -> tuple[str, object]:
    """(text, data in braces at its end or None)."""
    text = text.strip()
    if text.endswith("}"):
        for m in re.finditer(r"(?:^|(?<=\s))\{", text):
            try:
                said = text[m.start() :]
                return text[: m.start()].rstrip(), _short_data(said) if len(said) <= 64 else data(said)
            except ValueError:
                pass
    return text, None


def _raw_lines(body: str) -> list[dict]:
    """Elements in order: indent, mark, the text with lines that go on, and the inference in front of it."""
    out: list[dict] = []
    open_, inference, collecting, front = None, None, None, False
    body = _MULTI.sub(lambda m: "\n" * m[0].count("\n"), body.expandtabs(4))
    for number, line in enumerate(body.split("\n")):
        line = (_COMMENT.sub("", line) if "//" in line else line).rstrip()
        content = line.strip()
        if content.startswith("===") and not content.strip("=") and (front or not out and not number):
            front, open_ = not front, None
            continue
        if front or content.startswith("#") and re.match("#+ ", content):
            open_ = None
            continue
        if collecting is not None:
            collecting.append(content)
            if content.endswith("--"):
                inference, collecting = " ".join(collecting).strip(" -"), None
            continue
        if not content:
            open_ = None
            continue
        if content.startswith("--"):
            open_ = None
            if content == "--" or not content.endswith("--"):
                collecting = [content]
            else:
                inference = content.strip(" -")
            continue
        indent, mark, rest = _LINE.fullmatch(line).groups()
        if open_ is not None and mark is None and not _STARTS.match(rest):
            open_["text"] += " " + rest
            continue
        open_ = {"indent": len(indent), "mark": mark, "text": rest, "inference": inference}
        inference = None
        out.append(open_)
    if collecting is not None or inference is not None:
        raise ValueError("nothing follows an inference")
    return out


def _strings(x) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else []


class Keys(NamedTuple):
    """Names of what data in braces say: what an item is inferred from, a proposition's formula, and what its symbols mean."""

    inference: str = "from"
    formalization: str = "formalization"
    declarations: str = "declarations"


KEYS = Keys()


class _Graph:
    """Propositions, arguments and relations of a body."""

    def __init__(self, keys: Keys = KEYS):
        self.keys = keys
        self.propositions: dict[str, dict] = {}
        self.arguments: dict[str, dict] = {}
        self.relations: dict[tuple, list[str]] = {}

    def node(self, kind: str, label: str | None, text: str, given) -> str:
        """Add to a proposition or argument and give its key; without a label it gets one of its own."""
        own = self.propositions if kind == "proposition" else self.arguments
        key = label if label is not None else f"UNLABELED_{kind.upper()}_{len(own) + 1}"
        node = own.setdefault(key, {"label": key, "unlabeled": label is None, "texts": [], "data": None, "pcs": [], "annotation_ids": None, "formalization": None, "declarations": None, "declarations_kind": "none"})
        if text and text not in node["texts"]:
            node["texts"].append(text)
        if given is not None:
            node["data"] = "dict" if isinstance(given, dict) else "other"
            if isinstance(given, dict):
                if "annotation_ids" in given:
                    node["annotation_ids"] = _strings(given["annotation_ids"])
                if given.get(self.keys.formalization) is not None:
                    node["formalization"] = str(given[self.keys.formalization])
                declared = given.get(self.keys.declarations)
                node["declarations_kind"] = "dict" if isinstance(declared, dict) else "none" if declared is None else "other"
                node["declarations"] = [{"symbol": str(k), "meaning": str(v)} for k, v in declared.items()] if isinstance(declared, dict) else None
        return key

    def relate(self, source: str, source_argument: bool, target: str, target_argument: bool, valence: str, dialectic: str) -> None:
        known = self.relations.setdefault((source, source_argument, target, target_argument, valence), [])
        if dialectic not in known:
            known.append(dialectic)

    def ground(self) -> None:
        """What the items of arguments say about supports and attacks between labeled claims and arguments."""
        rivals: dict[str, set[str]] = {}
        rivals_of: dict[str, list[str]] = {}
        for source, a, target, b, valence in list(self.relations):
            if not a and not b and valence in ("ATTACK", "CONTRADICT"):
                rivals.setdefault(source, set()).add(target)
                if valence == "CONTRADICT":
                    rivals.setdefault(target, set()).add(source)
        for source, targets in rivals.items():
            for target in targets:
                rivals_of.setdefault(target, []).append(source)
        users: dict[str, list[str]] = {}
        for key, argument in self.arguments.items():
            for item in argument["pcs"]:
                if not item["is_conclusion"]:
                    users.setdefault(item["proposition"], []).append(key)
        named = lambda p: not self.propositions[p]["unlabeled"]
        for key, argument in self.arguments.items():
            if argument["pcs"] and argument["pcs"][-1]["is_conclusion"]:
                end = argument["pcs"][-1]["proposition"]
                for target, valence in [(end, "SUPPORT"), *((r, "ATTACK") for r in sorted(rivals.get(end, ())))]:
                    if named(target):
                        self.relate(key, True, target, False, valence, "GROUNDED")
                        for user in users.get(target, ()):
                            if user != key:
                                self.relate(key, True, user, True, valence, "GROUNDED")
        for premise, keys in users.items():
            for source, valence in [(premise, "SUPPORT"), *((r, "ATTACK") for r in rivals_of.get(premise, ()))]:
                if named(source):
                    for key in keys:
                        self.relate(source, False, key, True, valence, "GROUNDED")


def argdown(body: str, keys: Keys = KEYS) -> dict:
    """The graph of a body; ValueError if it can't be read: a dedent to a level never opened, an unclosed square bracket, an inference without item.

    Lines without mark or label right below another one go on with it. Comments, headings and front matter are left out.
    A bare declaration of an argument behind its own items counts as a further, empty gist."""
    graph, levels, current = _Graph(keys), [], None
    rows = _raw_lines(body)
    for place, row in enumerate(rows):
        indent, left = row["indent"], None
        while levels and levels[-1][0] >= indent:
            left = levels.pop()[0]
        if left not in (None, indent):
            raise ValueError("a line is indented like none above it")
        m = _NODE.fullmatch(row["text"])
        text, given = _with_data(m["text"])
        if not m["claim"] and text.startswith("["):
            raise ValueError("a label is not closed")
        if row["inference"] is not None and not m["item"]:
            raise ValueError("no item follows an inference")
        relation = _RELATIONS.get(row["mark"])
        if m["item"]:
            if current is None:
                current = graph.node("argument", None, "", None)
            key, is_argument = graph.node("proposition", m["claim"], text, given), False
            graph.arguments[current]["pcs"].append(_item(m["item"], key, row["inference"], keys.inference))
        elif m["argument"]:
            key, is_argument = graph.node("argument", m["argument"], text, given), True
            below = place + 1 < len(rows) and rows[place + 1]["indent"] > indent
            if not indent and not relation:
                if not text and not below and graph.arguments[key]["pcs"]:
                    graph.arguments[key]["texts"].append("")
                current = key
        else:
            key, is_argument = graph.node("proposition", m["claim"], text, given), False
            if not indent and not relation:
                current = None
        if relation and levels:
            valence, outward = relation
            ends = [(key, is_argument), levels[-1][1]]
            (source, a), (target, b) = ends if outward else ends[::-1]
            graph.relate(source, a, target, b, valence, "SKETCHED" if a or b else "AXIOMATIC")
        levels.append((indent, (key, is_argument)))
    graph.ground()
    claims = [{k: v for k, v in p.items() if k != "pcs"} for p in graph.propositions.values()]
    arguments = [{k: v for k, v in a.items() if k in ("label", "unlabeled", "texts", "data", "annotation_ids", "pcs")} for a in graph.arguments.values()]
    relations = [{"source": s, "source_argument": a, "target": t, "target_argument": b, "valence": v, "dialectics": sorted(d)} for (s, a, t, b, v), d in graph.relations.items()]
    return {"propositions": claims, "arguments": arguments, "relations": relations}


def _item(label: str, proposition: str, inference: str | None, from_key: str) -> dict:
    """An item of an argument; refs are null where the inference names no list of them."""
    item = {"label": label, "proposition": proposition, "is_conclusion": inference is not None, "inference": "none", "refs": None}
    if inference is not None:
        _, given = _with_data(inference)
        if isinstance(given, dict):
            item["inference"] = "dict" if from_key in given else "no key"
            if isinstance(given.get(from_key), list):
                item["refs"] = [{"label": str(x), "is_text": isinstance(x, str)} for x in given[from_key]]
            elif from_key in given:
                item["inference"] = "no list"
    return item
