"""URL expressions built from the RFC 3986 split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.functions.text import let, strip
from jobweave.vocab import TRACKING_PARAMS, TRACKING_PREFIX

# scheme, authority, path, query of RFC 3986 appendix B
_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def _decode(c: Column) -> Column:
    """Form decoding; a percent sign without two hex digits stays as it is."""
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    """Form encoding with the tilde kept and the asterisk encoded."""
    return F.replace(
        F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slash, no tracking parameters.

    The other parameters keep their order and are re-encoded, blank values are
    kept, the fragment is dropped.
    """
    return let(strip(url), lambda u: let(_canonical_parts(u), _assemble))


def _canonical_parts(u: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(_part(u, 4), "&", -1), lambda p: p != F.lit("")),
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(
                F.when(
                    F.contains(p, F.lit("=")), F.regexp_replace(p, r"^[^=]*=", "")
                ).otherwise(F.lit(""))
            ).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.startswith(F.lower(p["k"]), F.lit(TRACKING_PREFIX))
        & ~F.lower(p["k"]).isin(*TRACKING_PARAMS),
    )
    return F.struct(
        F.lower(_part(u, 1)).alias("scheme"),
        F.lower(_part(u, 2)).alias("host"),
        F.regexp_replace(_part(u, 3), "/+$", "").alias("path"),
        F.array_join(
            F.transform(
                kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
            ),
            "&",
        ).alias("query"),
    )


def _assemble(p: Column) -> Column:
    return F.concat(
        F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit("://"))).otherwise(F.lit("")),
        p["host"],
        F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]),
        F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit("")),
    )


def url_host(url: Column) -> Column:
    return F.lower(_part(strip(url), 2))


def is_http_url(url: Column) -> Column:
    return F.coalesce(
        strip(url).rlike(r"^[Hh][Tt][Tt][Pp][Ss]?://[^/?#\s]+([/?#]|$)"), F.lit(False)
    )


def normal_url(url: Column) -> Column:
    """Contract form of an http(s) URL: lower-case scheme and host, default port
    dropped, ``/`` for an empty path; the rest is untouched."""
    u = strip(url)
    scheme = F.lower(_part(u, 1))
    host = F.lower(_part(u, 2))
    host = (
        F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )
    path = _part(u, 3)
    rest = F.regexp_extract(u, r"^[^?#]*([?#].*)?$", 1)
    return F.concat(
        scheme, F.lit("://"), host,
        F.when(path == "", F.lit("/")).otherwise(path), rest,
    )
