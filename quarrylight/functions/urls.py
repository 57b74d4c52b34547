"""Address functions on columns, by patterns, so that malformed addresses give empty parts and no errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight import config

HOST = r"^[a-z]+://([^/?#]*)"
PATH = r"^[a-z]+://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path(url: Column) -> Column:
    """The path without closing slashes; `/` where there is none."""
    found = F.regexp_replace(F.regexp_extract(url, PATH, 1), "/+$", "")
    return F.when(found == "", F.lit("/")).otherwise(found)


def canonical(url: Column) -> Column:
    """https, lower-case host without `www.`, no query or fragment, a closing slash unless the last segment has a dot."""
    where = path(url)
    ending = F.when(where.rlike(r"\.[^/]*$") | (where == "/"), F.lit("")).otherwise(F.lit("/"))
    return F.concat(F.lit("https://"), F.regexp_replace(host(url), r"^www\.", ""), where, ending)


def kind(url: Column) -> Column:
    """Page kind by ordered rules."""
    return F.when(path(url) == "/", "home").when(host(url).rlike(r"^blog\."), "post").when(path(url).rlike(r"\.html$"), "document").when(host(url).rlike(r"^m\."), "mobile").otherwise("landing")


def openable(url: Column, suffix: str) -> Column:
    """The address if its scheme and host are allowed, else null; fragments go."""
    return F.when(url.rlike(r"^https?://") & host(url).endswith(suffix), F.regexp_replace(url, "#.*$", ""))


# What follows takes addresses of any scheme and case, as crawlers meet them.

ANY = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def once(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row: a lambda variable holds it."""
    return F.transform(F.array(value), body)[0]


def part(url: Column, n: int) -> Column:
    """Scheme (1), host and port (2), path (3), query (4); empty where there is none."""
    return F.regexp_extract(F.trim(url), ANY, n)


def without_dots(path: Column) -> Column:
    """A path whose `.` and `..` segments are resolved."""
    start = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(F.split(path, "/"), start, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, up(acc)).otherwise(acc)).otherwise(F.array_append(acc, x)))
    closed = F.array_join(kept, "/")
    return F.when(path.rlike(r"/\.\.?$"), F.concat(closed, F.lit("/"))).otherwise(closed)


def resolved(url: Column, base: Column) -> Column:
    """`url` as it is meant on the page `base`: absolute, //host, /path, ?query, #part and relative forms."""
    scheme, host_ = part(base, 1), part(base, 2)
    origin = F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit("://"), host_)
    folder = F.regexp_replace(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "[^/]*$", "")
    where, rest = F.regexp_extract(url, r"^([^?#]*)(.*)$", 1), F.regexp_extract(url, r"(?s)^([^?#]*)(.*)$", 2)
    bare = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(url == "", bare)
        .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(F.when(scheme == "", "https").otherwise(scheme), F.lit(":"), url))
        .when(url.startswith("#"), F.concat(bare, url))
        .when(url.startswith("?"), F.concat(F.regexp_replace(bare, r"\?.*$", ""), url))
        .when(url.startswith("/"), F.concat(origin, without_dots(where), rest))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, where)), rest))
    )


def site_path(url: Column) -> Column:
    """The path without closing slashes, `/` where nothing is left."""
    found = F.regexp_replace(part(url, 3), "/+$", "")
    return F.when(found == "", "/").otherwise(found)


def canonicalised(url: Column, base: Column | None = None, keep_paths: tuple = config.KEEP_QUERY_PATHS, keep_keys: tuple = config.KEEP_QUERY_KEYS) -> Column:
    """https unless said, lower-case host, a closing slash unless the last segment has a dot, no fragment; of the query chosen keys on chosen paths."""

    def made(u: Column) -> Column:
        where = F.regexp_replace(F.when(part(u, 3) == "", "/").otherwise(part(u, 3)), r";[^/]*$", "")
        return once(where, lambda w: F.concat(F.when(part(u, 1) == "", "https").otherwise(F.lower(part(u, 1))), F.lit("://"), F.lower(part(u, 2)), shown(w), query(u, w)))

    def shown(where: Column) -> Column:
        bare = F.regexp_replace(where, "/+$", "")
        last = F.regexp_extract(bare, r"([^/]*)$", 1)
        return F.when(last.contains(".") & ~last.startswith("."), F.when(bare == "", "/").otherwise(bare)).when(where.endswith("/"), where).otherwise(F.concat(where, F.lit("/")))

    def query(u: Column, where: Column) -> Column:
        pairs = F.filter(F.split(part(u, 4), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*keep_keys) & (F.length(p) > F.length(F.substring_index(p, "=", 1)) + 1))
        return F.when(F.regexp_replace(where, "/+$", "").isin(*keep_paths) & (F.size(pairs) > 0), F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")

    return once(F.trim(resolved(F.trim(url), base) if base is not None else url), made)


def listing_base(url: Column) -> Column:
    """A listing's address without its page number."""
    where = F.regexp_replace(part(url, 3), r"/page/\d+/?$", "/")
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), F.when(where.endswith("/"), where).otherwise(F.concat(where, F.lit("/"))))


def _segments(url: Column) -> Column:
    return F.filter(F.split(site_path(url), "/"), lambda x: x != "")


def allowed(url: Column, domains: list[str]) -> Column:
    host_ = F.lower(part(url, 2))
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (host_ == d) | F.endswith(host_, F.concat(F.lit("."), d)))


def denied(url: Column, extra: tuple[str, ...] = ()) -> Column:
    """Paths that are no content, and the blog, which has its own crawl."""
    p = F.lower(site_path(url))
    return F.exists(F.array(*(F.lit(x.lower()) for x in (*config.DENIED_PREFIXES, *extra, "/blog"))), lambda x: F.startswith(p, x) | (p == F.rtrim(x, F.lit("/"))))


def blog_post(url: Column) -> Column:
    s = _segments(url)
    return (F.size(s) == 2) & (F.get(s, F.lit(0)) == "blog") & ~F.get(s, F.lit(1)).isin("feed")


def listing(url: Column) -> Column:
    p = F.regexp_replace(part(url, 3), "/+$", "")
    return p.isin("/blog", "") | p.contains("/blog/category/") | F.concat(p, F.lit("/")).rlike(r"/blog/(category/[^/]+/)?page/\d+")


def category(url: Column) -> Column:
    return part(url, 3).contains("/blog/category/")


def pagination(url: Column) -> Column:
    return part(url, 3).rlike(r"/page/\d+/?$")


def homepage(url: Column) -> Column:
    return site_path(url) == "/"


def country_overview(url: Column) -> Column:
    return site_path(url).isin(*config.COUNTRY_PATHS) | site_path(url).rlike(r"^/country-overview/[^/]*$")


def service_landing(url: Column) -> Column:
    p = site_path(url)
    return p.rlike(r"^/services/overview/[^/]*$") | (~p.startswith("/services/funds") & (F.size(_segments(url)) == 2) & p.startswith("/services/"))


def service_package(url: Column) -> Column:
    s = _segments(url)
    return (F.size(s) >= 3) & (F.get(s, F.lit(0)) == "services") & ~F.get(s, F.lit(1)).isin("overview", "funds")


def case_study(url: Column) -> Column:
    s = _segments(url)
    return (F.size(s) == 2) & (F.get(s, F.lit(0)) == "case-studies") & ~F.get(s, F.lit(1)).isin("industries", "jurisdiction")


def announcement(url: Column, kind_: str) -> Column:
    """Press releases or events, by their folder."""
    s = _segments(url)
    return (F.size(s) >= 3) & (F.get(s, F.lit(0)) == "announcement") & (F.get(s, F.lit(1)) == kind_)


def product_detail(url: Column) -> Column:
    s = _segments(url)
    first = F.coalesce(F.get(s, F.lit(0)), F.lit(""))
    return (F.size(s) >= 2) & (first.isin("product-details", "product-detail") | ((first == "products") & ~denied(url)))


def hub(url: Column) -> Column:
    """Pages that lead to others."""
    p = site_path(url)
    named = p.isin("/", "/llms.txt", "/pricing-master-list", "/contact-us", "/case-studies", "/announcement/press-releases", "/announcement/events")
    return named | p.rlike("^(/case-studies/industries/|/case-studies/jurisdiction/|/product-listing|/services/funds)") | country_overview(url) | service_landing(url)


def page_kind(url: Column) -> Column:
    """The kind of a page by ordered rules; a page that none fits is a service's."""
    p = site_path(url)
    return (
        F.when(homepage(url), "hub")
        .when(p.endswith("llms.txt") | (p == "/contact-us"), "company")
        .when(announcement(url, "press-releases"), "press_release")
        .when(announcement(url, "events"), "event")
        .when(p.startswith("/announcement/"), "hub")
        .when(p.startswith("/pricing-master-list"), "pricing")
        .when((p == "/business-guides") | p.startswith("/business-guides/"), "business_guide")
        .when(case_study(url), "case_study")
        .when((p == "/case-studies") | p.startswith("/case-studies/industries/"), "hub")
        .when(country_overview(url), "country_overview")
        .when(p.startswith("/product-listing"), "package_listing")
        .when(p.startswith("/services/funds"), "fund")
        .when(product_detail(url), "product_detail")
        .when(service_package(url), "service_package")
        .otherwise("service_landing")
    )


def skipped(url: Column, kind_: Column | None = None) -> Column:
    """Pages that are found but not kept, by a kind that is known or by the address."""
    known = page_kind(url) if kind_ is None else F.coalesce(kind_, page_kind(url))
    return known.isin(*config.SKIPPED_KINDS) | (site_path(url) == "/business-guides")


def page_url(kind_: Column, slug: Column, site: str = config.SITE) -> Column:
    """The address of a page of a kind by its slug."""
    folder = F.when(kind_ == "product_detail", "/product-details/").when(kind_ == "country_overview", "/country-overview/").when(kind_ == "service_landing", "/services/overview/").when(kind_ == "file", "").otherwise("/")
    return F.when(kind_ == "file", F.concat(F.lit("https://drive.google.com/file/d/"), slug, F.lit("/view"))).otherwise(F.concat(F.lit(site), folder, slug))


def open_url(url: Column, hosts: tuple[str, ...] = config.OPENABLE_HOSTS) -> Column:
    """An address that may be opened, else null: http or https on a listed host; drive links are shared ones, product pages lose their closing slash."""
    u = F.trim(url)
    ok = u.rlike(r"(?i)^https?://") & allowed(u, list(hosts))
    drive = F.when(u.contains("usp=sharing"), u).when(u.contains("?"), F.concat(u, F.lit("&usp=sharing"))).otherwise(F.concat(u, F.lit("?usp=sharing")))
    return F.when(ok, F.when(part(u, 2).rlike(r"(?i)^(drive|docs)\.google\.com$"), drive).when(product_detail(u), F.regexp_replace(u, "/+$", "")).otherwise(u))


def chat_id(said: Column) -> Column:
    """The id of a chat within an address or text, else null."""
    return F.nullif(F.regexp_extract(said, r"([0-9][0-9-]*@(?:g|c)\.us)", 1), F.lit(""))


def invite_code(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)chat\.whatsapp\.com/(?:invite/)?([A-Za-z0-9_-]{10,})", 1), F.lit(""))


def phone_digits(said: Column) -> Column:
    """The digits of a number of 8 to 15 digits, else null."""
    digits = F.regexp_replace(F.regexp_replace(said, "@.*$", ""), "[^0-9]", "")
    return F.when(F.length(digits).between(8, 15), digits)


def chat_url(invite: Column, id_: Column) -> Column:
    """Where a chat opens: by its invite, else by the phone of a personal chat."""
    code, phone = invite_code(invite), F.when(id_.endswith("@c.us"), phone_digits(id_))
    return F.coalesce(F.concat(F.lit("https://chat.whatsapp.com/"), code), F.concat(F.lit("https://wa.me/"), phone))


def country_of(url: Column, slugs: dict[str, str]) -> Column:
    """The country of a page by the first segment of its path, or the one after country-overview; null for others."""
    s = _segments(url)
    first = F.lower(F.when(F.get(s, F.lit(0)) == "country-overview", F.get(s, F.lit(1))).otherwise(F.get(s, F.lit(0))))
    return F.create_map(*[F.lit(x) for pair in slugs.items() for x in pair])[first]


def slug_of(url: Column) -> Column:
    """The last segment of the path, decoded."""
    return F.try_url_decode(F.coalesce(F.try_element_at(_segments(url), F.lit(-1)), F.lit("")))
