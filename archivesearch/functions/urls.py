"""URL scalars as native Column expressions.

Everything here builds Catalyst expressions; nothing calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivesearch.functions._util import col_of, let

# Fixed values (must equal the reference's rules):
#   strip scheme:  ^\w+://
#   strip www:     ^www[0-9]*\.
#   URL test core: [a-zA-Z\d][-\w.]+\.[a-z.]{2,6}  (find; any line terminator fails)
SCHEME_RE = r"^\w+://"
WWW_RE = r"^www[0-9]*\."
URL_CORE_RE = r"[a-zA-Z0-9][-\w.]+\.[a-z.]{2,6}"
LINE_TERMINATORS_RE = r"[\n\r\u0085\u2028\u2029]"

# scheme, authority, path, query, fragment
_URL_PARTS_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_AUTH_RE = r"^(?:[^@]*@)?([^:]*)(:[0-9]*)?$"
_USERINFO_RE = r"^([^@]*@)?"
# A URL whose canonical form begins with http: in any case before ://, as written elsewhere.
WEB_RE = (r"^(?:<(?=.*>$)(?:http|[hH][tT][tT][pP][A-Za-z0-9+.\-]*://(?!>$))"
          r"|http|[hH][tT][tT][pP][A-Za-z0-9+.\-]*://(?![\r\n\x{85}\x{2028}\x{2029}]*$))")
# A web URL that canonicalisation and stripping change in scheme, www and final slash only: lower-case host names, no port, user, query
# or dot segment. Groups: host without www, path without final slash. Possessive, so that long paths take no stack.
_PLAIN_CHARS = r"A-Za-z0-9_~%+=,;@!*'()$&\-"
_PLAIN_RE = (r"^https?://(?:www[0-9]*+\.)?+(?![0-9.]++(?:/|\z))([a-z0-9\-]++(?:\.[a-z0-9\-]++)++)"
             rf"((?:/[{_PLAIN_CHARS}][{_PLAIN_CHARS}.]*+)*+)/?\z")
_DEFAULT_PORTS = {"http": ":80", "https": ":443", "ws": ":80", "wss": ":443", "ftp": ":21"}


def strip_ending_slash(u) -> Column:
    """remove one trailing slash."""
    return F.regexp_replace(col_of(u), "/$", "")


def strip_protocol_www(u) -> Column:
    """strip ``scheme://`` then ``www<digits>.``; a trailing slash goes only with a strip."""
    def step(c: Column, pattern: str) -> Column:
        return let(strip_ending_slash(c), lambda s: F.when(
            s.rlike(pattern), F.regexp_replace(s, pattern, "")).otherwise(c))

    return let(col_of(u), lambda c: let(step(c, SCHEME_RE), lambda a: step(a, WWW_RE)))


def _resolve_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path (``..`` never pops the root)."""
    segs = F.split(path, "/")
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(folded, "/")
    ends_dot = path.rlike(r"/\.\.?$")
    return F.concat(joined, F.when(ends_dot, F.lit("/")).otherwise(F.lit("")))


def canonical_url(u) -> Column:
    """drop a ``<...>`` wrapper and one trailing slash, then normalise.

    Lower-case scheme and host, drop the scheme's default port, resolve dot segments,
    empty path becomes ``/``; query and fragment are kept. Strings without a scheme are
    returned after the first two steps. Empty or null input gives null.
    """
    return let(col_of(u), _canonical)


def _canonical(c: Column) -> Column:
    unwrapped = F.when(c.startswith("<") & c.endswith(">") & (F.length(c) >= 2),
                       c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(
        let(strip_ending_slash(unwrapped), _rebuild))


def _rebuild(s: Column) -> Column:
    scheme = F.lower(F.regexp_extract(s, _URL_PARTS_RE, 1))
    path = F.regexp_extract(s, _URL_PARTS_RE, 3)
    query = F.regexp_extract(s, _URL_PARTS_RE, 4)
    frag = F.regexp_extract(s, _URL_PARTS_RE, 5)
    default_port = F.coalesce(
        F.create_map(*[x for k, v in _DEFAULT_PORTS.items() for x in (F.lit(k), F.lit(v))])[scheme],
        F.lit(""))

    def authority(auth: Column) -> Column:
        userinfo = F.regexp_extract(auth, _USERINFO_RE, 1)
        host = F.lower(F.regexp_extract(auth, _AUTH_RE, 1))
        port = let(F.regexp_extract(auth, _AUTH_RE, 2), lambda p: F.when(
            (p == default_port) | (p == ":"), F.lit("")).otherwise(p))
        return F.concat(userinfo, host, port)

    path = let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(_resolve_dots(p)))
    rebuilt = F.concat(scheme, F.lit("://"), let(F.regexp_extract(s, _URL_PARTS_RE, 2), authority),
                       path, query, frag)
    return F.when(s.rlike(_URL_PARTS_RE), rebuilt).otherwise(s)


def surt_from_stripped(s) -> Column:
    """SURT of a scheme-less, www-less URL: ``(tld,domain,sub,[:port])path``.

    Hosts are lower-cased already by F3. IPv4 hosts are not reversed.
    """
    return let(col_of(s), _surt_of)


def _surt_of(c: Column) -> Column:
    def build(hostport: Column) -> Column:
        rest = F.substring(c, F.length(hostport) + 1, 1 << 30)
        port = F.regexp_extract(hostport, r"(:[0-9]*)$", 1)
        rev = let(F.regexp_extract(hostport, r"^([^:]*)", 1), lambda host: F.when(
            host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), host).otherwise(
            F.array_join(F.reverse(F.split(host, r"\.")), ",")))
        head = F.concat(F.lit("("), rev, F.lit(","), port)
        return let(rest, lambda r: F.when(r == "", head).otherwise(F.concat(head, F.lit(")"), r)))

    return let(F.regexp_extract(c, r"^([^/?#]*)", 1), build)


def surt(u) -> Column:
    """canonical URL -> strip scheme and www -> SURT."""
    return surt_from_stripped(strip_protocol_www(canonical_url(u)))


# ------------------------------------------------------------------ the same rules in steps
#
# A Column function copies or binds what it uses several times. On tables of URLs the steps are
# projections one after the other instead: each part is computed once, as generated code, and only a path that
# has dot segments meets the interpreted expression that resolves them.

_HAS_DOTS_RE = r"/\.\.?(/|$)"


def _canonical_steps(src: Column, out: str, p: str) -> list[dict[str, Column]]:
    c = lambda name: F.col(f"{p}{name}")
    port = F.coalesce(F.create_map(*[x for k, v in _DEFAULT_PORTS.items() for x in (F.lit(k), F.lit(v))])[c("scheme")], F.lit(""))
    return [
        {f"{p}src": F.when(src != "", src)},
        {f"{p}s": strip_ending_slash(F.when(c("src").startswith("<") & c("src").endswith(">") & (F.length(c("src")) >= 2),
                                            c("src").substr(F.lit(2), F.length(c("src")) - 2)).otherwise(c("src")))},
        {f"{p}scheme": F.lower(F.regexp_extract(c("s"), _URL_PARTS_RE, 1)), f"{p}auth": F.regexp_extract(c("s"), _URL_PARTS_RE, 2),
         f"{p}path": F.regexp_extract(c("s"), _URL_PARTS_RE, 3), f"{p}query": F.regexp_extract(c("s"), _URL_PARTS_RE, 4),
         f"{p}frag": F.regexp_extract(c("s"), _URL_PARTS_RE, 5)},
        {f"{p}port": F.regexp_extract(c("auth"), _AUTH_RE, 2), f"{p}default": port, f"{p}dots": c("path").rlike(_HAS_DOTS_RE)},
        {f"{p}path": F.when(c("dots"), _resolve_dots(c("path"))).otherwise(c("path"))},
        {out: F.when(c("scheme") == "", c("s")).otherwise(F.concat(
            c("scheme"), F.lit("://"), F.regexp_extract(c("auth"), _USERINFO_RE, 1), F.lower(F.regexp_extract(c("auth"), _AUTH_RE, 1)),
            F.when((c("port") == c("default")) | (c("port") == ":"), F.lit("")).otherwise(c("port")),
            F.when(c("path") == "", F.lit("/")).otherwise(c("path")), c("query"), c("frag")))}]


def _surt_steps(canonical: Column, out: str, p: str) -> list[dict[str, Column]]:
    c = lambda name: F.col(f"{p}{name}")

    def strip(src: Column, name: str, pattern: str) -> list[dict[str, Column]]:
        return [{f"{p}{name}_cut": strip_ending_slash(src)},
                {f"{p}{name}": F.when(c(f"{name}_cut").rlike(pattern), F.regexp_replace(c(f"{name}_cut"), pattern, "")).otherwise(src)}]

    return [
        *strip(canonical, "bare", SCHEME_RE), *strip(c("bare"), "own", WWW_RE),
        {f"{p}hostport": F.regexp_extract(c("own"), r"^([^/?#]*)", 1)},
        {f"{p}host": F.regexp_extract(c("hostport"), r"^([^:]*)", 1), f"{p}at": F.regexp_extract(c("hostport"), r"(:[0-9]*)$", 1),
         f"{p}rest": F.substring(c("own"), F.length(c("hostport")) + 1, 1 << 30)},
        {f"{p}turned": F.when(c("host").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), c("host")).otherwise(
            F.array_join(F.reverse(F.split(c("host"), r"\.")), ","))},
        {out: F.concat(F.lit("("), c("turned"), F.lit(","), c("at"), F.when(c("rest") == "", F.lit("")).otherwise(F.concat(F.lit(")"), c("rest"))))}]


def _in_steps(df: DataFrame, steps: list[dict[str, Column]], out: str, prefix: str) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    # A filter or join on the result must not be pushed through the steps: it would hold all of them, copied. A condition
    # that is no function of the row (and always true) stops it here.
    df = df.withColumn(out, F.when(F.monotonically_increasing_id() >= 0, F.col(out)))
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def _prefix(df: DataFrame) -> str:
    """A beginning that no column of ``df`` has."""
    prefix = "_url_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def with_canonical(df: DataFrame, url: str, out: str) -> DataFrame:
    """``df`` with F3 of its column ``url`` as ``out``; no exchange."""
    p = _prefix(df)
    return _in_steps(df, _canonical_steps(F.col(url), out, p), out, p)


def with_surt(df: DataFrame, url: str, out: str) -> DataFrame:
    """``df`` with F4 of its column ``url`` as ``out``; no exchange. Plain URLs are taken apart by one pattern; the steps see
    the others only (a null for the rest, which costs them nothing)."""
    p = _prefix(df)
    canonical, host, path, other, slow = (f"{p}{n}" for n in ("canonical", "plain_host", "plain_path", "other", "slow"))
    plain = F.concat(F.lit("("), F.array_join(F.reverse(F.split(F.col(host), r"\.")), ","), F.lit(","),
                     F.when(F.col(path) == "", F.lit("")).otherwise(F.concat(F.lit(")"), F.col(path))))
    return _in_steps(df, [
        {host: F.regexp_extract(F.col(url), _PLAIN_RE, 1), path: F.regexp_extract(F.col(url), _PLAIN_RE, 2)},
        {other: F.when(F.col(host) == "", F.col(url))},
        *_canonical_steps(F.col(other), canonical, p), *_surt_steps(F.col(canonical), slow, p),
        {out: F.when(F.col(host) == "", F.col(slow)).otherwise(plain)}], out, p)


def surt_to_url(s) -> Column:
    """SURT back to an ``https://`` URL; anything else is treated as a URL."""
    return let(col_of(s), _surt_to_url)


def _surt_to_url(c: Column) -> Column:
    open_i = F.instr(c, "(")  # 1-based, 0 when absent
    close_i = F.instr(c, ")")
    has_slash = F.instr(c, "/") > 0

    def hosts(prefix: Column) -> Column:
        parts = F.filter(F.split(prefix, ","), lambda p: F.length(p) > 0)
        return F.array_join(F.reverse(parts), ".")

    only_domain = F.concat(F.lit("https://"), hosts(F.substring(c, open_i + 1, 1 << 30)))
    with_path = F.concat(
        F.lit("https://"),
        hosts(c.substr(open_i + 1, close_i - open_i - 1)),
        F.substring(c, close_i + 1, 1 << 30))
    chosen = (F.when((close_i == 0) & ~has_slash, only_domain)
              .when((open_i > 0) & (close_i > 0), with_path)
              .otherwise(c))
    return canonical_url(chosen)


def url_host(u) -> Column:
    """host of an absolute URL (lower-cased), null when it has none."""
    h = F.regexp_extract(col_of(u), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^:/?#]*)", 1)
    return F.when(h == "", F.lit(None).cast("string")).otherwise(F.lower(h))


def is_url(u) -> Column:
    """does the text look like a URL (one line holding ``host.tld``)?"""
    c = col_of(u)
    return c.rlike(URL_CORE_RE) & ~c.rlike(LINE_TERMINATORS_RE)


def url_key(u) -> Column:
    """exact-URL key of the legacy backend, hex MD5 of the URL."""
    return F.md5(col_of(u))


def resolve_link(base, href) -> Column:
    """resolve a link against its page URL; unparsable links are kept as they are."""
    b = col_of(base)
    h = F.trim(col_of(href))
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_query = F.regexp_extract(b, r"^([^?#]*)", 1)
    directory = F.regexp_extract(no_query, r"^(.*/)", 1)
    return (F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, h))
            .when(origin == "", h)
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(no_query, h))
            .when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), h))
            .when(h == "", b)
            .when(directory.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*/"), F.concat(directory, h))
            .otherwise(F.concat(origin, F.lit("/"), h)))


def expand_url_variants(u) -> Column:
    """The http and https variants of a URL, as an array (explode to look both up)."""
    body = F.regexp_replace(col_of(u), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.array(F.concat(F.lit("http://"), body), F.concat(F.lit("https://"), body))
