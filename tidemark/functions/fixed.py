"""Fixed values that results depend on: word lists, patterns and weights, stated in natural order."""

# English stop words of the index tokenizer.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is it its be as was are were been has have had do does did will would could "
    "should may might shall can not no nor so yet both either neither each this that these those which who whom what when where why how "
    "all any few more most other some such than too very just also into onto upon about above after before between during through under "
    "over then if up out he she we they you me him her us them my your his our their i"
).split()

# Bounds of a token's length in bytes.
TOKEN_BYTES = (2, 40)

# Path fragments and title starts of pages without content of their own.
AUTH_PATHS = "/login /signin /signup /join /register /sessions /password /auth/ /oauth/ /account/ /sso/".split()
WIKI_PATHS = (
    "/wiki/file: /wiki/talk: /wiki/user: /wiki/user_talk: /wiki/wikipedia: /wiki/template: /wiki/category: /wiki/special: /wiki/help: "
    "/wiki/portal: /wiki/draft: /wiki/module:"
).split()
LISTING_PATHS = (
    "/pulls /pull/ /forks /stargazers /watchers /labels /custom-properties /network /graphs/ /branches /commits /compare /actions /runs/ "
    "/workflows/ /issues? /tags /releases/tag/ /blame/ /raw/ /tree/"
).split()
JUNK_TITLES = ["File:", "Talk:", "User:"]
JUNK_SUFFIXES = ".flac .mp3 .wav .ogg .pdf .zip".split()
PROFILE_PATHS = "/@ /users/ /user/ /profile/ /people/ /u/".split()

# What the titles of error pages say.
ERROR_TITLES = [
    "502: bad gateway", "502 bad gateway", "503 service", "504 gateway", "404 not found", "403 forbidden", "500 internal",
    "wikimedia error", "error 502", "error 503", "error 404", "page not found", "access denied",
]

# Domains.
PREFERRED_TLDS = "com org net edu gov io co ai".split()
INFRA_NAMES = "cdn static api cache proxy analytics tracking pixel adserver syndication".split()
COMPOUND_TLDS = "co.uk co.jp com.au co.in org.uk ac.uk com.br co.kr".split()
SECOND_LEVELS = "co com org net gov edu ac".split()
HOME_PATHS = ["", "/", "/index.html", "/index.htm"]

# Addresses a crawl skips.
SKIP_EXTENSIONS = (
    ".tar.gz .tgz .tar.bz2 .tar.xz .gz .bz2 .xz .zip .rar .7z .msi .exe .dmg .pkg .deb .rpm .appimage .iso .img .pdf .doc .docx .xls .xlsx "
    ".ppt .pptx .png .jpg .jpeg .gif .webp .svg .ico .bmp .tiff .mp3 .mp4 .avi .mkv .mov .flv .wmv .wav .ogg .webm .woff .woff2 .ttf .eot "
    ".otf .css .js .mjs .map .wasm .bin .dat .o .so .dylib .dll .a .lib"
).split()
SKIP_FRAGMENTS = "/login /signup /join /sessions /password_reset /auth/ /oauth/ /wp-admin/ /wp-login /cart /checkout /feed/ /rss /atom.xml ?page= &page=".split()
BLOCKED_SCHEMES = "javascript mailto tel data ftp file".split()

# Domains that discovery leaves out or prefers.
JUNK_TLDS = ".cn .ru .su .ir .kp".split()
INFRA_KEYWORDS = "cdn static cache proxy tracker analytics adserver pixel beacon telemetry syndication usercontent userimages assets embed".split()
INFRA_SUFFIXES = (
    "googleapis.com gstatic.com googlevideo.com googleusercontent.com google-analytics.com googletagmanager.com googleadservices.com "
    "googlesyndication.com doubleclick.net fbcdn.net twimg.com mzstatic.com akamai.net akamaihd.net akamaized.net cloudfront.net fastly.net "
    "amazonaws.com windows.net gtld-servers.net root-servers.net"
).split()
RICH_KEYWORDS = (
    "blog docs dev wiki news tech science research engineering learn tutorial guide community forum discuss magazine journal review article "
    "write code data open edu university mit stanford berkeley"
).split()
OPEN_SCOPE_WORDS = "news aggregat forum discuss".split()

# Tags of the text extraction.
STRIP_TAGS = "script style noscript nav footer header aside iframe svg canvas form button input select textarea figure".split()
BLOCK_TAGS = "p div section article main h1 h2 h3 h4 h5 h6 blockquote pre li tr br hr".split()

# Weights of ranking.
BM25_K1, BM25_B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3, "headings": 2, "meta_description": 1, "body": 1}
RRF_K = 60
BOOST = {
    "domain_exact": 0.15, "domain_prefix": 0.04, "homepage": 0.12, "brand": 0.10, "nav_homepage": 0.35, "shallow": 0.004, "title": 0.02,
    "title_prefix": 0.01, "multi_source": 0.01, "junk": -0.06, "deep": -0.006, "error": -0.025, "profile": -0.015, "tld": 0.02, "freshness": 0.008,
}
