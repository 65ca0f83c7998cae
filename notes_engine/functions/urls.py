"""Addresses: guards, canonical forms and video ids, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid"]
VIDEO_HOSTS = ["youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be", "www.youtu.be"]
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent."""
    return F.regexp_extract(url, _PARTS, k)


def is_address(source: Column) -> Column:
    return source.rlike(r"^(?i)https?://[^/]+")


def _decoded(x: Column) -> Column:
    """A query's name or value; what is no valid escape stays as it is."""
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    """As form fields are encoded; ``~`` stays and ``*`` does not."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _joined(scheme: Column, authority: Column, rest: Column) -> Column:
    head = F.when(scheme != "", F.concat(scheme, F.lit("://"), authority)).when(authority != "", F.concat(F.lit("//"), authority)).otherwise("")
    return F.concat(head, rest)


def _parts(url: Column) -> Column:
    return F.struct(*[part(url, k).alias(n) for k, n in enumerate(("scheme", "authority", "path", "query"), 1)])


def canonical(url: Column) -> Column:
    """Scheme and host in lower case; no trailing slash, fragment or tracking parameters; the query encoded anew."""

    def whole(u: Column) -> Column:
        path = F.when(u["path"] == "/", F.lit("/")).otherwise(F.regexp_replace(u["path"], "/+$", ""))
        pairs = F.transform(F.filter(F.split(u["query"], "&"), lambda p: p != ""), lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("name"), _decoded(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value")))
        kept = F.filter(pairs, lambda p: ~p["name"].startswith("utm_") & ~p["name"].isin(TRACKING))
        query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["name"]), F.lit("="), _encoded(p["value"]))), "&")
        head = _joined(F.lower(u["scheme"]), F.lower(u["authority"]), path)
        return let(query, lambda q: F.concat(head, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))

    return let(_parts(url), whole)


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments worked out."""
    none = F.array().cast("array<string>")
    parts = F.split(path, "/")
    kept = F.aggregate(parts, none, lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(ended, "/")


def resolved(base: Column, link: Column) -> Column:
    """A link of a page at ``base`` as a whole address."""

    def whole(u: Column) -> Column:
        x, b = u["link"], u["base"]
        own = F.regexp_extract(x, r"^([^?#]*)", 1)
        tail = F.regexp_replace(x, r"^[^?#]*", "")
        folder = F.regexp_replace(F.when(b["path"] == "", F.lit("/")).otherwise(b["path"]), "[^/]*$", "")
        query = F.when(b["query"] == "", "").otherwise(F.concat(F.lit("?"), b["query"]))
        path = let(F.when(x.startswith("/"), own).otherwise(F.concat(folder, own)), _without_dots)
        rest = F.when(x.startswith("?"), F.concat(b["path"], x)).when(x.startswith("#"), F.concat(b["path"], query, x)).otherwise(F.concat(path, tail))
        here = _joined(b["scheme"], b["authority"], rest)
        return F.when(x == "", base).when(part(x, 1) != "", x).when(x.startswith("//"), F.concat(b["scheme"], F.lit(":"), x)).otherwise(here)

    return let(F.struct(F.trim(link).alias("link"), _parts(base).alias("base")), whole)


def short_id(url: Column) -> Column:
    return F.substring(F.sha2(canonical(url), 256), 1, 16)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


# Networks of four-part addresses that are private, link-local, reserved or for many receivers, as (network, bits).
REFUSED_V4 = [("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
              ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
ALLOWED_V4 = [("192.0.0.9", 32), ("192.0.0.10", 32)]
# Ranges of the first 48 bits of six-part addresses, and those within them that are not private, as (network, bits).
OPEN_V6 = [("2000 0 0", 3), ("fec0 0 0", 10)]
REFUSED_V6 = [("2001 0 0", 23), ("2001 db8 0", 32), ("2002 0 0", 16)]
ALLOWED_V6 = [("2001 3 0", 32), ("2001 4 112", 48), ("2001 20 0", 28), ("2001 30 0", 28)]


def _within(number: Column, networks: list[tuple[str, int]], width: int) -> Column:
    """Whether the first ``width`` bits of an address lie in one of the networks."""
    out = F.lit(False)
    for at, bits in networks:
        parts = [int(x) for x in at.split(".")] if "." in at else [int(x, 16) for x in at.split()]
        first = sum(x << (8 if "." in at else 16) * i for i, x in enumerate(reversed(parts)))
        out = out | number.between(first, first + (1 << (width - bits)) - 1)
    return out


def _v4(x: Column) -> Column:
    """A four-part address as a number; null if it is none."""
    good = lambda b: b.rlike(r"^(0|[1-9]\d{0,2})\z") & (b.try_cast("int") <= 255)
    number = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda n, p: n * 256 + p.try_cast("long"))
    return let(F.split(x, r"\."), lambda b: F.when((F.size(b) == 4) & F.forall(b, good), number(b)))


def _private_v4(number: Column) -> Column:
    return let(number, lambda n: _within(n, REFUSED_V4, 32) & ~_within(n, ALLOWED_V4, 32))


def _v6(x: Column) -> Column:
    """The eight parts of a six-part address (text without brackets) as numbers; null if it is none."""
    none = F.array().cast("array<string>")
    dotted = lambda n: F.concat(F.regexp_replace(x, r"[^:]*\z", ""), F.lower(F.hex(F.call_function("div", n, F.lit(65536)))), F.lit(":"), F.lower(F.hex(n % 65536)))
    whole = let(_v4(F.regexp_extract(x, r"([^:]*)\z", 1)), lambda n: F.when(n.isNull(), x).otherwise(dotted(n)))
    pieces = lambda side: F.coalesce(F.filter(F.split(side, ":"), lambda p: p != ""), none)

    def parts(w: Column) -> Column:
        sides = F.split(w, "::", 2)
        both = F.struct(pieces(F.get(sides, F.lit(0))).alias("left"), pieces(F.get(sides, F.lit(1))).alias("right"), (F.size(sides) == 2).alias("short"))
        return let(both, lambda s: let(F.lit(8) - F.size(s["left"]) - F.size(s["right"]), lambda missing: F.when(
            ~w.contains(":::") & (F.size(F.split(w, "::")) <= 2) & F.when(s["short"], missing > 0).otherwise(missing == 0) & F.forall(F.concat(s["left"], s["right"]), lambda p: p.rlike(r"^[0-9a-f]{1,4}\z")),
            F.transform(F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["right"]), lambda p: F.conv(p, 16, 10).cast("long")))))

    return let(whole, lambda w: F.when(w.rlike(r"^[0-9a-f:]+\z") & w.contains(":"), parts(w)))


def _private_v6(parts: Column) -> Column:
    first = lambda p: (F.get(p, F.lit(0)) * 65536 + F.get(p, F.lit(1))) * 65536 + F.get(p, F.lit(2))
    return let(parts, lambda p: let(first(p), lambda n: ~_within(n, OPEN_V6, 48) | _within(n, REFUSED_V6, 48) & ~_within(n, ALLOWED_V6, 48)))


def refusal(url: Column) -> Column:
    """Why an address must not be fetched, or null."""

    def judged(u: Column) -> Column:
        h, six = u["host"], u["six"]
        return (
            F.when(url.isNull() | (u["url"] == ""), "empty")
            .when(~F.lower(part(u["url"], 1)).isin("http", "https"), "scheme")
            .when((h == "") | h.startswith("[") & six.isNull(), "host")
            .when(F.length(u["url"]) > 4096, "too long")
            .when(h == "localhost", "local")
            .when(F.coalesce(u["four"], _private_v6(six), F.lit(False)), "private")
        )

    u = F.trim(url)
    bare = lambda h: F.regexp_extract(h, r"^\[(.*)\]$", 1)
    return let(host(u), lambda h: let(F.struct(u.alias("url"), h.alias("host"), _v6(bare(h)).alias("six"), _private_v4(_v4(h)).alias("four")), judged))


def is_video_id(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9_-]{11}\z")


def video_id(url: Column) -> Column:
    """The id of a video address or a bare id; null for anything else."""
    u = F.trim(url)
    full = F.when(u.rlike("^(?i)https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    h, path = host(full), part(full, 3)
    named = F.filter(F.split(part(full, 4), "&"), lambda p: p.rlike("^v=."))
    from_query = _decoded(F.regexp_replace(F.get(named, F.lit(0)), "^v=", ""))
    in_path = lambda form: F.nullif(F.regexp_extract(path, form, 1), F.lit(""))
    found = F.coalesce(
        F.when((path == "/watch") & is_video_id(from_query), from_query),
        in_path("^/(?:embed|shorts|live|v)/([A-Za-z0-9_-]{11})(?:/|$)"),
        in_path("^/([A-Za-z0-9_-]{11})(?:/|$)"),
    )
    from_url = F.when((F.length(u) <= 2000) & h.isin(VIDEO_HOSTS) & is_video_id(found), found)
    return F.when(is_video_id(u), u).otherwise(from_url)


def watch_address(vid: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), vid)
