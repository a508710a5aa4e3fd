"""A small labelled table of invented URLs, made by a rule from words by topic, under names reserved for documentation.

Each topic's words are set into a few forms of host and path, chosen by a checksum, so no
form tells the label. Every fifth word of a topic is held out: its URLs are for measuring only.
"""

from __future__ import annotations

from zlib import crc32

#: Topics that a training corpus leaves out, by the words that their hosts and paths hold.
BLOCKED = {
    "gambling": "casino poker roulette jackpot slots blackjack betting bookmaker lottery bingo baccarat wager gamble sportsbet freebets spins win odds",
    "medicine by mail": "viagra cialis pills pharmacy-deals no-prescription steroids dietpills cheap-meds painkiller sildenafil weightloss-pills supplements-cheap",
    "adult": "adult xxx porn escort sexcam nude hot-singles erotic fetish webcam-girls adult-chat hookup",
    "advertising": "ads adserver tracker track click-track popunder banner-ads pixel affiliate-clicks adclick impressions retarget ad-sync",
    "link trade": "spam link-farm backlinks buy-followers seo-links content-farm doorway article-spinner cheap-traffic bulk-mail free-likes farm",
    "fraud": "free-money prize-claim payday-loan instant-cash get-rich verify-account login-update giveaway crypto-double inheritance fast-loan winner",
    "illegal copies": "warez keygen crack torrent-free serial-number nulled cracked-apps iso-download free-movies-hd mod-apk stream-ripper leak",
    "replicas": "replica-watch cheap-bags fake-rolex outlet-sale designer-replica cheap-jerseys knockoff discount-brand cheap-sneakers wholesale-fake",
}
#: Topics that it keeps.
ALLOWED = {
    "learning": "university library school course lecture college academy student teacher physics chemistry mathematics biology grammar",
    "news": "news daily tribune gazette herald report weather politics economy editorial interview press",
    "reference": "wiki dictionary encyclopedia archive museum history atlas biography glossary catalogue maps manual",
    "science": "astronomy ocean climate genome geology laboratory institute journal papers research telescope species",
    "leisure": "recipes garden cooking hiking chess cycling painting theatre music guitar football knitting travel",
    "public life": "council parliament ministry hospital court railway harbour postal election statistics",
    "computing": "python database compiler kernel tutorial forum software documentation network developer opensource release",
    "writing": "blog poetry novel essay letters stories review translation notebook column magazine diary",
    "made-up names": "tarvel ondrin belmora kistane halver moresta ulbring dantel eskoria pelwin sorrain tilmond varesk",
}
FORMS = (
    "www.{w}.example/en/{n}", "{w}-{v}.test/{n}.html", "blog.{w}.example/de/{n}", "{v}{w}.test/fr/{n}", "m.{w}-{v}.example/{n}/", "{w}.example/es/{v}-{n}", "{v}.test/{w}/{n}", "www.{v}-{w}.test/en/{n}",
)
HOLD_OUT, EACH = 5, 3


def rows(held_out: bool) -> list[tuple[str, float]]:
    """(url, label): EACH forms of each word, beside a neighbour of its topic; label 1 is for block."""
    out = []
    for topics, label in ((BLOCKED, 1.0), (ALLOWED, 0.0)):
        for said in topics.values():
            words = said.split()
            parts = [[w for i, w in enumerate(words) if (i % HOLD_OUT == HOLD_OUT - 1) == h] for h in (False, True)]
            own = parts[held_out]
            for i, w in enumerate(own):
                for k in range(EACH):
                    code = crc32(f"{w} {k}".encode())
                    form, n, v = FORMS[code % len(FORMS)], code // 8 % 9000, own[(i + 1 + k) % len(own)]
                    out.append((f"http{'s' * (code >> 20 & 1)}://{form.format(w=w, v=v, n=n)}", label))
    return out


ROWS = rows(False)
HELD_OUT = rows(True)
