"""URL filter: prefix rules, then a logistic regression on hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed features, and lengths of the character n-grams.
BUCKETS, SIZES = 1 << 14, (3, 4, 5)
#: The part of addresses to block that the model takes for usual: an address that tells nothing is allowed.
BLOCKED = 0.2
#: (host, path prefix, verdict); a rule also holds for all subdomains of its host.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The labelled URL table, written for this purpose: well-known kinds of sites to allow, and patterns of addresses that public block lists hold.
LABELLED = {
    "allow": """en.wikipedia.org/wiki/Distributed_computing github.com/apache/spark/tree/master docs.python.org/3/library/re.html stackoverflow.com/questions/11227809 www.bbc.co.uk/news/science-56837908 www.nytimes.com/2021/05/11/health/sleep.html www.gutenberg.org/files/1342/1342-h.htm arxiv.org/abs/1706.03762
        www.nature.com/articles/s41586-020-2649-2 developer.mozilla.org/en-US/docs/Web/HTML/Element www.lemonde.fr/culture/article/2020/exposition www.spiegel.de/wissenschaft/natur/klima elpais.com/deportes/2021-06-02/liga.html www.theguardian.com/books/2019/sep/review openlibrary.org/works/OL45804W archive.org/details/letters_1914 www.nasa.gov/missions/mars
        www.who.int/news-room/fact-sheets/detail/malaria ec.europa.eu/info/policies_en www.gov.uk/browse/benefits www.un.org/en/about-us/history www.loc.gov/collections/maps www.britannica.com/topic/philosophy www.mit.edu/education/courses www.ox.ac.uk/research/history stanford.edu/class/cs224n/slides.html www.coursera.org/learn/machine-learning www.khanacademy.org/math/algebra
        www.imdb.com/title/tt0111161/reviews www.goodreads.com/book/show/5107 www.allrecipes.com/recipe/tomato-soup www.bbcgoodfood.com/recipes/lentil-curry www.nhs.uk/conditions/asthma www.mayoclinic.org/diseases-conditions/flu www.webmd.com/diet/guide/vitamins www.lonelyplanet.com/italy/rome www.nationalgeographic.com/animals/mammals/tiger
        www.weather.gov/forecast/week medium.com/@writer/how-we-build-things-3f2a dev.to/maria/testing-notes-2k1 news.ycombinator.com/item?id=1 www.reddit.com/r/gardening/comments/roses gitlab.com/group/project/-/issues/12 pypi.org/project/requests crates.io/crates/serde www.npmjs.com/package/express hub.docker.com/_/postgres www.postgresql.org/docs/current/indexes.html
        free-software-foundation.org/licenses/gpl library.city.gov/catalogue/free-books www.city-museum.org/collection/paintings blog.gardening.net/2019/roses www.football-league.org/results/2020 www.chess-club.org/games/openings music-archive.org/songs/folk www.photography-forum.org/thread/lenses www.parliament.gov/bills/2020 courts.gov/cases/2004/review www.hospital.org/patients/advice
        www.university.edu/library/papers school-district.org/calendar/spring jobs.company.com/engineer/berlin shop.bookstore.com/novels/classics www.bank.com/help/accounts maps.country.gov/regions/north www.theatre.org/season/plays dictionary.org/word/meaning www.farmers-market.org/seeds/wheat history.archive.org/timeline www.zoo.org/animals/tigers blog.cycling.org/tour/alps
        m.daily-news.com/en/politics/election de.travel-notes.org/reise/berlin fr.cuisine-maison.com/recettes/soupe es.noticias.com/economia/mercado www.recipes.com/it/pasta forum.linux.org/threads/kernel.991 wiki.archlinux.org/title/Network lists.debian.org/debian-user/2021/03 www.w3.org/TR/html52 datatracker.ietf.org/doc/html/rfc2616 sourceforge.net/projects/audacity
        www.poets.org/poem/winter www.sciencedirect.com/science/article/pii/S0 www.jstor.org/stable/2118 www.oecd.org/economy/outlook www.redcross.org/get-help www.unicef.org/reports/children www.techradar.com/reviews/laptops www.wired.com/story/climate www.economist.com/leaders/2021 apnews.com/article/science www.reuters.com/world/europe""".split(),
    "block": """www.pornhub.com/view_video.php www.xvideos.com/video12345/title xhamster.com/videos/amateur www.redtube.com/12345 www.youporn.com/watch/1234 www.xnxx.com/search/milf free-porn-tube.xxx/videos/hot hot-sex-cams.com/live/girls nude-celebs-leak.xxx/pics/nude adult-cams-live.com/sex/girls sexy-babes.xxx/gallery/nude escort-girls-city.com/adult/sex
        hentai-manga.xxx/read/uncensored milf-tube.com/videos/hd amateur-porn-hd.com/watch/anal xxx-movies-free.net/download/porn www.adultfriendfinder.com/go/page/sex hookup-singles.xxx/tonight/girls www.bet365.com/casino/slots www.pokerstars.com/poker/real-money free-casino-bonus.com/slots/jackpot online-poker-win.com/bet/now best-betting-odds.bet/casino/roulette
        casino-royal-spin.bet/slot/spins sports-bets-odds.bet/gambling/live jackpot-slots-777.com/play/free-spins bitcoin-casino.io/games/blackjack lottery-winner.club/claim/prize mega-slot-games.win/spin/bonus www.888casino.com/promotions/bonus betting-tips-daily.bet/odds/football cheap-viagra-pills.com/buy/cialis online-pharmacy-rx.biz/order/viagra
        weight-loss-miracle.biz/diet/pills male-enhancement-pills.top/order/now buy-xanax-online.biz/no-prescription steroids-shop.biz/buy/anabolic replica-watches-cheap.biz/rolex/buy fake-designer-bags.top/louis/outlet get-rich-fast.biz/earn/money crypto-doubler.top/bitcoin/free forex-signals-profit.biz/earn/daily payday-loans-now.biz/credit/instant
        loan-shark-fast.biz/money/cash work-from-home-cash.club/earn/weekly free-gift-cards.club/claim/now win-free-iphone.club/prize/claim survey-rewards.club/prize/winner secure-paypal-login.top/verify/account appleid-verify-account.tk/signin/update bank-of-america-secure.ga/login/confirm netflix-billing-update.ml/account/payment microsoft-support-alert.top/call/now
        phishing-login.top/verify/password account-suspended.cf/restore/login fake-antivirus.top/scan/virus malware-update.top/install/setup.exe flash-player-update.xyz/download/exe trojan-dropper.xyz/payload/bin keygen-crack-download.top/warez/full warez-serials.com/crack/serial torrent-warez-crack.com/keygen/download thepiratebay.org/torrent/movie pirate-movies-free.club/torrent/stream
        cracked-apps-apk.top/mod/download nulled-scripts.top/themes/download free-movies-123.top/watch/hd camrip-streams.club/torrent/film ad.doubleclick.net/ddm/clk/click googleads.g.doubleclick.net/pagead/ads adserver-popups.com/ads/click click-ads-tracker.com/banner/ad tracking-pixel.xyz/pixel/track.gif popads.network/serve/ads
        adclick-redirect.top/out/click affiliate-links-spam.biz/click/offer spam-seo-links.biz/backlinks/buy buy-followers-cheap.biz/instagram/likes link-farm-directory.biz/submit/links cheap-essays-online.biz/order/essay hacked-accounts.top/passwords/buy carding-forum.top/dumps/cvv stolen-cards.top/fullz/shop botnet-rental.top/ddos/buy""".split(),
}


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to /, ? or #, A-Z lower-cased) and path (on
    from there up to ? or #); both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams; the host's and the path's are told apart."""
    marked = (b"^" + host.encode() + b"$", b"/" + path.encode())
    found = {zlib.crc32(text[k : k + n], part) % BUCKETS for part, text in enumerate(marked) for n in SIZES for k in range(len(text) - n + 1)}
    return np.fromiter(found, np.int64, len(found))


def train(labelled: dict[str, list[str]] | None = None, steps: int = 600, rate: float = 5.0, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of block against allow, by full gradient steps; the rows to block have BLOCKED of the weight."""
    rows = [(features(*url.split("/", 1)), float(verdict == "block")) for verdict, urls in (labelled or LABELLED).items() for url in urls]
    each = np.concatenate([own for own, _ in rows])
    at = np.repeat(np.arange(len(rows)), [len(own) for own, _ in rows])
    scale = 1 / np.sqrt(np.bincount(at))
    y = np.array([v for _, v in rows])
    share = np.where(y == 1, BLOCKED / y.sum(), (1 - BLOCKED) / (1 - y).sum())
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        off = (1 / (1 + np.exp(-(np.bincount(at, weights[each]) * scale + bias))) - y) * share
        weights -= rate * (np.bincount(each, (off * scale)[at], BUCKETS) + l2 * weights)
        bias -= rate / 10 * off.sum()
    return weights, bias


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of pages.

    The longest rule that fits decides; where none does, the model (block at a
    score of 0.5 or more).  score is the model's in any case.  A null URL or one
    without :// has empty host and path and no n-grams: the model's bias judges
    it, which allows it.  Repeated rows are judged alike; an empty table gives an empty result;
    other columns are ignored.
    """
    weights, bias = train()
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = features(host, path.removeprefix("/"))
                z = float(weights[own].sum()) / max(1, len(own)) ** 0.5 + bias
                scores.append(1 / (1 + float(np.exp(-z))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], ["page_id", "host", "path", "score"])

    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = host_path(F.col("_url"))
    parted = df.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, "page_id long, host string, path string, score double")
    rule = verdict = F.lit(None).cast("string")
    for at, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(prefix)
        rule, verdict = F.when(fits, F.lit(at + prefix)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return parted.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "score")
