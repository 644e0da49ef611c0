"""The URL model on addresses of other sites, and against plain sums."""

from __future__ import annotations

import math
import zlib

from cuesmith.llm import url_rules

OTHERS = {
    "allow": "github.com/user/free-software www.oreilly.com/library/view/python www.smithsonianmag.com/history/egypt kubernetes.io/docs/concepts www.cambridge.org/core/journals www.metmuseum.org/art/collection www.deutschlandfunk.de/nachrichten/politik www.liberation.fr/sports/football www.cnn.com/2020/11/world/index.html www.usgs.gov/programs/earthquake-hazards scikit-learn.org/stable/modules/tree.html www.epicurious.com/recipes/bread ocw.mit.edu/courses/physics news.sky.com/story/weather example.com/en/77 blog.example.org/es/33 m.example.org/de/48 www.epa.gov/air-quality www.cdc.gov/vaccines/index.html".split(),
    "block": "www.pornhub.com/categories/teen spankbang.com/porn/video free-sex-videos.xxx/watch/hot www.casinoonline.bet/slots/free-spins hot-poker-room.com/poker/bonus cheap-cialis-online.biz/buy/pills paypal-account-verify.tk/login/secure fast-payday-cash.biz/loans/instant crack-keygen-full.top/download/serial adserver.example.biz/ads/banner/click xxx-girls-live.cam/nude/sex win-big-jackpot.club/casino/prize bitcoin-doubler-now.top/free/earn viagra-discount.biz/order/cialis torrent-movies-hd.club/torrent/download".split(),
}


def plain_score(url: str) -> float:
    weights, bias = url_rules.train()
    host, path = url.split("/", 1)
    found = set()
    for part, text in enumerate((f"^{host}$".encode(), f"/{path}".encode())):
        for n in url_rules.SIZES:
            for k in range(len(text) - n + 1):
                found.add(zlib.crc32(text[k : k + n], part) % url_rules.BUCKETS)
    z = math.fsum(float(weights[f]) for f in found) / math.sqrt(len(found)) + bias
    return 1 / (1 + math.exp(-z))


def test_addresses_of_other_sites(spark):
    """No host here is in the labelled table but one, with another path."""
    urls = [(u, v) for v, own in OTHERS.items() for u in own]
    rules = {r["page_id"]: r for r in url_rules.judge_urls(spark.createDataFrame([(i, "http://" + u) for i, (u, _) in enumerate(urls)], "page_id long, url string"), rules=()).collect()}
    wrong = [(u, v, rules[i]["score"]) for i, (u, v) in enumerate(urls) if rules[i]["verdict"] != v]
    assert len(wrong) <= 2, wrong
    for i in range(0, len(urls), 7):
        assert abs(rules[i]["score"] - plain_score(urls[i][0])) < 1e-5


def test_host_and_path_follow_their_column(spark):
    host, path = url_rules.host_path(spark.range(1).selectExpr("'HTTP://A.b/c?d' AS other").other)
    df = spark.createDataFrame([("HTTP://A.b/c?d", "x")], "other string, _url string")
    assert tuple(df.select(*url_rules.host_path(df.other)).first()) == ("a.b", "/c")
