"""Rules over texts: addresses without secrets, plain page text and quotes in it, the part of a JSON detail that may be
shown, and labels of where a value comes from."""

from __future__ import annotations

import json
import re
from urllib.parse import parse_qsl, quote, unquote, urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Names of query parameters that carry a secret, in lower case without - and _.
SECRET_PARAMETERS = ("key", "apikey", "token", "accesstoken", "secret", "dkey", "xcgdemoapikey", "xcgproapikey", "xapikey", "authtoken", "accesskey", "password", "auth", "authorization")
#: Hosts whose paths carry a key.
KEYED_HOSTS = ("alchemy.com", "infura.io", "drpc.org", "publicnode.com", "quiknode.pro", "ankr.com", "blastapi.io", "chainstack.com", "helius-rpc.com", "nodereal.io", "getblock.io")
#: Keys of a detail whose texts may be shown.
SHOWN_NAMES = frozenset(("primary_source", "check_source", "source", "scan", "sender", "month", "day", "tx", "check_id", "check_type"))
#: Tags inside a sentence; every other tag ends a block of text.
INLINE_TAGS = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "img", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "u", "var", "wbr")
#: Entities and what they stand for.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "lsquo": "'", "rsquo": "'", "ldquo": '"', "rdquo": '"', "ndash": "-", "mdash": "-", "hellip": "...", "amp": "&"}
#: Names of a locator's entries that carry a secret, in lower case without - and _, and of those emptied whole.
SECRET_NAMES = ("authorization", "password", "secret", "apikey", "accesstoken", "privatekey", "apitoken")
EMPTIED_NAMES = ("headers", "auth")
#: Hexadecimal addresses and hashes, versions, what may be a key behind a version, and long segments.
HEX_ADDRESS, VERSION = re.compile("0x([0-9a-fA-F]{40}|[0-9a-fA-F]{64})"), re.compile("v[0-9]+")
BEHIND_VERSION, LONG_SEGMENT = re.compile("[A-Za-z0-9_-]{8,}"), re.compile("[A-Za-z0-9_-]{20,}")
#: Tags by which a page counts as HTML.
HTML_TAGS = (
    "a address article aside b blockquote body br caption dd details div dl dt em figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html i img li main nav ol p pre section span strong"
    " summary table tbody td tfoot th thead tr ul"
)
#: Fewest characters of a quote that proves anything.
QUOTE_LENGTH = 20
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443}

_CONTROL = "".join(map(chr, range(0x21)))
_ADDRESS = re.compile(r"(?is)(?P<scheme>https?|wss?):[/\\]*(?:[^/\\?#]*@)?(?P<host>[^/\\?#:@]+)(?::(?P<port>[0-9]{0,9}))?(?P<path>[/\\][^?#]*)?(?:\?(?P<query>[^#]*))?(?:#.*)?\Z")
_NO_HOST = re.compile(r"[\x00-\x20<>\[\]^|%\x7f]")
_IN_TEXT = re.compile(r"(?i)\b(?:https?|wss?)://[^\s\"'<>]+")
#: What stays as it is in a path, and in a query.
_PATH, _QUERY = "/%:@!$&'()*+,;=~[]|\\^", "/%:@!$&()*+,;=~[]|\\^?`{}"
_OPEN, _CLOSE = re.compile(r"(?i)<(script|style)\b"), {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_TAG, _ANY_TAG = re.compile("<[^>]*>"), re.compile(r"(?i)</?([a-z][a-z0-9-]*)\b[^>]*>")
_LINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([^\s()]*(?:\([^\s()]*\)[^\s()]*)*\)")
_DECIMAL, _HEX, _NAMED = re.compile("&#([0-9]+);"), re.compile("(?i)&#x([0-9a-f]+);"), re.compile("(?i)&([a-z]+);")
_HTML = re.compile(rf"(?i)</?(?:{'|'.join(HTML_TAGS.split())})\b[^>]*>")
_BLANK, _RULE = re.compile(r"\n[ \t\r]*\n"), re.compile(":?-+:?")
_PLAIN = str.maketrans({**dict.fromkeys("\u2018\u2019\u201a\u2032", "'"), **dict.fromkeys("\u201c\u201d\u201e\u2033", '"'), **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-")})


def _address(text: str) -> str | None:
    """A web address without user, fragment, secret parameters and segments of the path that may be keys; None if the text is
    no web address. Read as browsers read addresses: schemes and hosts in any case, names of parameters decoded."""
    m = _ADDRESS.match(re.sub(r"[\t\n\r]", "", text.strip(_CONTROL)))
    if not m or m["port"] and int(m["port"]) > 65535:
        return None
    scheme, host = m["scheme"].lower(), unquote(m["host"]).lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if _NO_HOST.search(host):
        return None
    port = f":{int(m['port'])}" if m["port"] and int(m["port"]) != PORTS[scheme] else ""
    keyed = any(host == h or host.endswith("." + h) for h in KEYED_HOSTS)
    segments: list[str] = []
    for s in quote((m["path"] or "").replace("\\", "/"), safe=_PATH).split("/"):
        plain = s.lower().replace("%2e", ".")
        if plain == "..":
            segments = segments[:-1]
        elif s and plain != ".":
            segments.append(s)

    def shown(i: int, s: str) -> bool:
        if not keyed and HEX_ADDRESS.fullmatch(s):
            return True
        behind = i > 0 and i == len(segments) - 1 and VERSION.fullmatch(segments[i - 1]) and BEHIND_VERSION.fullmatch(s) and re.search("[0-9_]", s)
        return not (behind or (keyed and not VERSION.fullmatch(s)) or (LONG_SEGMENT.fullmatch(s) and re.search("[0-9]", s)))

    kept = "/".join(s for i, s in enumerate(segments) if shown(i, s))
    query = m["query"]
    if query is not None:
        pairs = parse_qsl(query, keep_blank_values=True)
        open_pairs = [p for p in pairs if p[0].lower().replace("-", "").replace("_", "") not in SECRET_PARAMETERS]
        if len(open_pairs) < len(pairs):
            query = urlencode(open_pairs, safe="*") or None
        else:
            query = quote(query, safe=_QUERY)
    return f"{scheme}://{host}{port}/{kept}" + (f"?{query}" if query is not None else "")


def scrub_text(text: str) -> str:
    """Every web address inside a text scrubbed."""
    return _IN_TEXT.sub(lambda m: m[0] if (found := _address(m[0])) is None else found, text)


def scrub_json(x: object) -> object:
    """A JSON value without credentials: entries of secret names are dropped, those of headers and auth emptied, every address
    in a text is scrubbed, at any depth."""
    if isinstance(x, str):
        return scrub_text(x)
    if isinstance(x, list):
        return [scrub_json(y) for y in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        if k.lower().replace("-", "").replace("_", "") in SECRET_NAMES:
            continue
        if k.lower() in EMPTIED_NAMES:
            out[k] = [] if isinstance(v, list) else {} if isinstance(v, dict) else "" if isinstance(v, str) else v
        else:
            out[k] = scrub_json(v)
    return out


@pandas_udf(StringType())
def scrubbed(url: pd.Series) -> pd.Series:
    """A web address without what may be secret: user, fragment, secret parameters, and segments of the path that may be keys
    (on keyed hosts all but versions, elsewhere a long one with digits but for hexadecimal addresses and hashes, and a last
    one behind a version). A text that is no web address stays as it is."""
    return url.map(lambda u: None if u is None else u if (found := _address(u)) is None else found, na_action=None)


@pandas_udf(StringType())
def scrubbed_locator(locator: pd.Series) -> pd.Series:
    """scrub_json() of a JSON text; null if it is no JSON, so that nothing unread is shown."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(scrub_json(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return locator.map(one, na_action=None)


def _code(m: re.Match, base: int) -> str:
    n = int(m[1], base)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]


def _without_scripts(text: str, instead: str) -> str:
    """One scan: an end that follows nowhere is looked for once."""
    out, at, gone = [], 0, set()
    place = _OPEN.search(text)
    while place:
        name, then = place[1].lower(), place.end()
        end = None if name in gone else _CLOSE[name].search(text, then)
        if end is None:
            gone.add(name)
        else:
            out += [text[at : place.start()], instead]
            at = then = end.end()
        place = _OPEN.search(text, then)
    return "".join([*out, text[at:]])


def _on_tags(pattern: re.Pattern, by: object, text: str) -> str:
    """pattern replaced as far as tags can end, so that openings without an end take no time."""
    end = text.rfind(">") + 1
    return pattern.sub(by, text[:end]) + text[end:]


def normalized(text: str) -> str:
    """Scripts, styles and tags out, links of markdown as their text, entities resolved, plain quotation marks and dashes,
    single spaces."""
    out = _on_tags(_TAG, " ", _without_scripts(text, " "))
    out = _LINK.sub(r"\1", out)
    out = _DECIMAL.sub(lambda m: _code(m, 10), out)
    out = _HEX.sub(lambda m: _code(m, 16), out)
    out = _NAMED.sub(lambda m: ENTITIES.get(m[1].lower(), m[0]), out)
    return " ".join(out.translate(_PLAIN).split())


def _cells(line: str) -> list[str] | None:
    """The cells of a table row of markdown; None for another line."""
    t = line.strip()
    if not t.startswith("|"):
        return None
    return [c.strip() for c in t.removeprefix("|").removesuffix("|").split("|") if not _RULE.fullmatch(c.strip())]


def _broken(tag: re.Match) -> str:
    name = tag[1].lower()
    return "\n" if name == "br" else tag[0] if name in INLINE_TAGS else "\n\n"


def blocks(page: str) -> list[str]:
    """Blocks of a page's plain text, in order. Blank lines end a block; in HTML, where other white space is only that, so do
    tags that don't stand inside sentences. Cells of tables are blocks. A single line break (a <br>, in plain text any)
    ends one too, but before a lower-case letter."""
    out: list[str] = []
    html = _HTML.search(page[: page.rfind(">") + 1]) is not None
    for chunk in _BLANK.split(_without_scripts(page, "\n\n")):
        if html:
            chunk = _on_tags(_ANY_TAG, _broken, re.sub(r"\s+", " ", chunk))
        for part in _BLANK.split(chunk):
            current = ""
            for raw in part.split("\n"):
                cells = _cells(raw)
                line = "" if cells is not None else normalized(raw)
                if cells is None and current and "a" <= line[:1] <= "z":
                    current += f" {line}"
                elif line or cells is not None:
                    out += [current] if current else []
                    current = line
                    out += [c for c in map(normalized, cells or ()) if c]
            out += [current] if current else []
    return out


@pandas_udf(StringType())
def plain_text(text: pd.Series) -> pd.Series:
    """normalized() of each text."""
    return text.map(lambda t: None if t is None else normalized(t), na_action=None)


@pandas_udf(ArrayType(StringType()))
def text_blocks(page: pd.Series) -> pd.Series:
    """blocks() of each page; none of a null one."""
    return page.map(lambda t: [] if t is None else blocks(t), na_action=None)


@pandas_udf(StringType())
def normalized_url(url: pd.Series) -> pd.Series:
    """An address by which a cited page is found: scheme and host in lower case, without fragment and a last slash; the query
    stays, as it may select the page. What is no address stays as it is, without space around it."""

    def one(text: str | None) -> str | None:
        m = None if text is None else _ADDRESS.match(text.strip())
        if m is None:
            return None if text is None else text.strip()
        port = f":{m['port']}" if m["port"] and int(m["port"]) != PORTS[m["scheme"].lower()] else ""
        path = m["path"] or "/"
        return f"{m['scheme'].lower()}://{m['host'].lower()}{port}{path[:-1] if len(path) > 1 and path.endswith('/') else path}" + (f"?{m['query']}" if m["query"] else "")

    return url.map(one, na_action=None)


def _shown(x: object, name: str = "") -> object:
    if isinstance(x, dict):
        return {k: y for k, v in x.items() if (y := _shown(v, k)) is not ...}
    if isinstance(x, list):
        return [y for v in x if (y := _shown(v, name)) is not ...]
    return x if not isinstance(x, str) or name in SHOWN_NAMES else ...


@pandas_udf(StringType())
def reading_of(detail: pd.Series) -> pd.Series:
    """What of a JSON detail may be shown, at any depth: numbers, flags, nulls, and texts under SHOWN_NAMES. Null if that
    is nothing or the detail is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            found = _shown(json.loads(text)) if text is not None else ...
        except ValueError:
            return None
        return None if found is ... else json.dumps(found, separators=(",", ":"), ensure_ascii=False)

    return detail.map(one, na_action=None)


@pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The JSON with keys in order at every depth and no spaces, so that equal values have equal digests; null if it is no
    JSON."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one, na_action=None)


def origin(method: Column, source_type: Column, adapter: Column, adapter_origin: Column, formula: Column, input_origin: Column) -> Column:
    """onchain, api or manual. A disclosed value is manual unless it is a constant or an adapter gave it; a derived one is
    manual by its formula, else as its inputs; a measured one is onchain where a chain was read, unless its adapter reads
    elsewhere."""
    disclosed = F.when((source_type == "constant") | adapter.isNotNull(), "api").otherwise("manual")
    derived = F.when(F.coalesce(F.startswith(formula, F.lit("manual_")), F.lit(False)), "manual").when((F.coalesce(input_origin, F.lit("")) == "api") | (source_type == "third_party"), "api").otherwise("onchain")
    measured = F.when(source_type.isin("log_scan", "pool_scan"), "onchain").when(source_type == "contract_state", F.coalesce(adapter_origin, F.lit("onchain"))).otherwise("api")
    return F.when(method == "disclosed", disclosed).when(method == "derived", derived).when(method == "measured", measured)


def source_label(rung: Column, kind: Column, adapter: Column, url: Column) -> Column:
    """<rung>:<what>: the adapter, the host of an address, the kind of source, or manual without one; never an address."""
    host = F.regexp_extract(url, r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    what = F.when(kind.isNull(), "manual").when(kind == "adapter", adapter).when(kind == "http_json", host).otherwise(kind)
    return F.concat(rung, F.lit(":"), what)


def source_id(kind: Column, *details: Column) -> Column:
    """The key of a source's entry in a run: the kind, and what tells its sources apart."""
    rest = F.concat_ws(":", *details)
    return F.when(kind.isin("coingecko", "constant"), kind).when(kind.isin("erc20_supply", "contract_read"), "chain_levels").otherwise(F.concat(kind, F.lit(":"), rest))
