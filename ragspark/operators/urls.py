"""URL references in native expressions (SCA-06, EXT-10): resolution by RFC 3986 and unquoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority with its slashes, path, query with its mark, fragment with its mark
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
#: Schemes whose references are resolved.
HIERARCHICAL = ["ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def fold_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments and without empty segments in its middle; ``..`` at the root stays there."""
    parts = F.split(path, "/", -1)
    size = F.size(parts)
    last = F.element_at(parts, -1)
    inner = F.filter(parts, lambda x, i: (x != "") | (i == 0) | (i == size - 1))
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    folded = F.aggregate(inner, F.array().cast("array<string>"), step)
    folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(folded, "/")
    return F.when(joined == "", "/").otherwise(joined)


def resolve(base: Column, reference: Column) -> Column:
    """The absolute address of a reference found on the page ``base``; an empty one is the base; null if either is null."""
    scheme, other = F.lower(_part(base, 1)), F.lower(_part(reference, 1))
    foreign = ((other != "") & (other != scheme)) | ~F.when(other != "", other).otherwise(scheme).isin([*HIERARCHICAL, ""])
    host, path, query, fragment = (_part(reference, i) for i in (2, 3, 4, 5))
    base_path = _part(base, 3)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    merged = F.when(path.startswith("/"), path).when((folder == "") & (_part(base, 2) != ""), F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    folded = fold_dots(merged)
    # More steps up than there are segments end at the root of a host.
    folded = F.when((_part(base, 2) != "") & ~folded.startswith("/"), F.concat(F.lit("/"), folded)).otherwise(folded)
    # A query mark or fragment mark with nothing after it goes.
    kept = lambda c: F.when(F.length(c) > 1, c).otherwise("")
    lead = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise("")
    own_query = F.when(F.length(query) > 1, query).otherwise(_part(base, 4))
    out = F.when(foreign, reference).when(F.length(host) > 2, F.concat(lead, host, path, kept(query), kept(fragment)))
    out = out.when(path == "", F.concat(lead, _part(base, 2), base_path, kept(own_query), kept(fragment)))
    out = out.otherwise(F.concat(lead, _part(base, 2), folded, kept(query), kept(fragment)))
    return F.when(reference == "", base).when(base == "", reference).otherwise(out)


def unquote(url: Column) -> Column:
    """Percent escapes decoded as UTF-8; ``+`` stays, and so does a ``%`` that begins no escape."""
    safe = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), url)
