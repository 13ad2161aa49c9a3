"""Types and fixed values of the access-log model."""

from __future__ import annotations

from pyspark.sql import types as T

# Month names in log time stamps.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

# Extensions that make a 2xx answer a file; anything else is a page.
FILE_EXTENSIONS = (
    ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".otf", ".woff",
    ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".zip", ".tar", ".gz", ".br", ".pdf", ".xml",
    ".json", ".txt",
)

# Methods and protocols that are counted by name.
METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS", "PATCH")
PROTOCOLS = {"HTTP/1.0": "1.0", "HTTP/1.1": "1.1", "HTTP/2": "2.0", "HTTP/2.0": "2.0", "HTTP/3": "3.0", "HTTP/3.0": "3.0"}

# User-agent families that are always bots, by substring of the lower-case family.
BOT_FAMILIES = (
    "googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider", "yandexbot", "sogou", "exabot",
    "ia_archiver", "facebot", "ahrefsbot", "semrushbot", "mj12bot", "dotbot", "blexbot", "petalbot",
    "crawlerng", "rogerbot", "linkdreamer", "screaming frog", "libwww-perl", "python-urllib",
    "python-requests", "curl", "wget", "java", "apache-httpclient", "go-http-client",
)

# A raw user agent that has one of these, whatever its case, or a word that ends in "bot", is a bot.
BOT_WORDS = ("crawl", "spider", "scraper", "archiver", "checker", "monitor", "validator", "fetcher", "reader", "slurp", "indexer")
BOT_ENDING = r"bot\b"

UNKNOWN_COUNTRY = ("--", "Unknown")

#: A hit later than this after the visitor's last one starts a new visit.
VISIT_SECONDS = 1800

# Status labels, long form ("Code 200 - OK") and short form.
STATUS_LABELS = {
    100: "Continue", 101: "Switching Protocols", 200: "OK", 201: "Created", 202: "Accepted", 204: "No Content",
    206: "Partial Content", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified",
    307: "Temporary Redirect", 308: "Permanent Redirect", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden",
    404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 410: "Gone", 429: "Too Many Requests",
    500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
}
STATUS_ZERO, STATUS_ZERO_SHORT = "Undefined response code", "Unknown"
SHORT_STATUS_LABELS = {
    200: "200 OK", 201: "201 Created", 202: "202 Accepted", 204: "204 No Content", 206: "206 Partial",
    301: "301 Moved", 302: "302 Found", 304: "304 Not Modified", 307: "307 Temp Redirect", 308: "308 Perm Redirect",
    400: "400 Bad Request", 401: "401 Unauthorized", 403: "403 Forbidden", 404: "404 Not Found", 405: "405 Not Allowed",
    406: "406 Not Acceptable", 410: "410 Gone", 429: "429 Too Many Reqs", 500: "500 Server Error", 502: "502 Bad Gateway",
    503: "503 Unavailable", 504: "504 Gateway Timeout",
}

# Chart colours.
PALETTE = ("#52c493", "#66ddff", "#ff7a7a", "#ffc055", "#7090ff", "#ffea66", "#b0a8e6", "#808080", "#a8a8a8", "#d0d0d0")
STATUS_COLOURS = {2: "#52c493", 3: "#7090ff", 4: "#ffc055", 5: "#ff7a7a"}
OTHER_COLOUR = "#bab0ac"

#: Families by the first rule that holds: the agent starts with, has any of, or has all of the texts. Own rules, from the
#: product tokens that each program puts in its agent; what imitates another's token comes before it.
FAMILY_RULES = (
    ("Googlebot", "any", ("Googlebot",)), ("bingbot", "any", ("bingbot",)), ("YandexBot", "any", ("YandexBot",)), ("AhrefsBot", "any", ("AhrefsBot",)),
    ("SemrushBot", "any", ("SemrushBot",)), ("MJ12bot", "any", ("MJ12bot",)), ("DotBot", "any", ("DotBot",)), ("PetalBot", "any", ("PetalBot",)), ("Applebot", "any", ("Applebot",)),
    ("DuckDuckBot", "any", ("DuckDuckBot",)), ("Baiduspider", "any", ("Baiduspider",)), ("Yahoo! Slurp", "any", ("Yahoo! Slurp",)), ("Twitterbot", "any", ("Twitterbot",)), ("LinkedInBot", "any", ("LinkedInBot",)),
    ("FacebookBot", "any", ("facebookexternalhit", "Facebot")), ("Bytespider", "any", ("Bytespider",)),
    ("curl", "start", ("curl/",)), ("Wget", "start", ("Wget/",)), ("python-requests", "start", ("python-requests/",)), ("Python-urllib", "start", ("Python-urllib/",)), ("Python aiohttp", "any", ("aiohttp/",)),
    ("Go-http-client", "start", ("Go-http-client/",)), ("Java", "start", ("Java/",)), ("Apache-HttpClient", "start", ("Apache-HttpClient/",)), ("libwww-perl", "any", ("libwww-perl",)), ("okhttp", "start", ("okhttp/",)), ("axios", "start", ("axios/",)),
    ("HeadlessChrome", "any", ("HeadlessChrome/",)), ("PhantomJS", "any", ("PhantomJS/",)), ("Electron", "any", ("Electron/",)),
    ("Edge", "any", ("Edg/", "Edge/", "EdgA/", "EdgiOS/")), ("Opera Mini", "any", ("Opera Mini/",)), ("Opera", "any", ("OPR/", "Opera", "OPT/")), ("Samsung Internet", "any", ("SamsungBrowser/",)), ("Vivaldi", "any", ("Vivaldi/",)),
    ("Yandex Browser", "any", ("YaBrowser/",)), ("UC Browser", "any", ("UCBrowser/", "UBrowser/")), ("QQ Browser", "any", ("QQBrowser/",)), ("Whale", "any", ("Whale/",)), ("MiuiBrowser", "any", ("MiuiBrowser/",)), ("Huawei Browser", "any", ("HuaweiBrowser/",)),
    ("DuckDuckGo", "any", ("DuckDuckGo/", "Ddg/")), ("Amazon Silk", "any", ("Silk/",)), ("Puffin", "any", ("Puffin/",)), ("Maxthon", "any", ("Maxthon",)), ("Epiphany", "any", ("Epiphany/",)), ("Konqueror", "any", ("Konqueror/",)),
    ("SeaMonkey", "any", ("SeaMonkey/",)), ("Pale Moon", "any", ("PaleMoon/",)), ("Waterfox", "any", ("Waterfox/",)), ("Firefox Focus", "any", ("Focus/", "Klar/")), ("Firefox", "any", ("Firefox/", "FxiOS/")),
    ("Chromium", "any", ("Chromium/",)), ("Chrome", "any", ("Chrome/", "CriOS/")), ("Android Browser", "all", ("Android", "Version/")), ("Safari", "all", ("Version/", "Safari/")), ("Internet Explorer", "any", ("MSIE ", "Trident/")),
    ("Lynx", "start", ("Lynx/",)), ("w3m", "start", ("w3m/",)),
)

LINES = T.StructType([T.StructField("id", T.LongType()), T.StructField("value", T.StringType())])

COUNTERS = ("hits", "visits", "files", "pages", "bandwidth", "status_2xx", "status_3xx", "status_4xx", "status_5xx")
HOURLY = T.StructType([T.StructField("date", T.StringType()), T.StructField("hour", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in (*COUNTERS, "sites")])
