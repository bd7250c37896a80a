"""A small labelled URL table: 1 is a page that a training corpus should not take, 0 one that it may.

Built by rule from hand-written lists, apart from the filter's own host and path rules. An unwanted host has a word of gambling, pills,
adult pages, pirated software, loans and phishing, or ad and link farms, in one of the word's spellings; another host has everyday words, or is a
name made of frequent letter groups. Half of the urls of either class have a page that tells (`/bonus/`, `/wiki/`), the
others a numbered page in some language. Subdomains, endings, languages, and the words put before or after a word are the same in both.
"""

from __future__ import annotations

# fixed values: words of hosts, in families that share letters, and the pages they have
UNWANTED = (
    "casino casinos livecasino casinobonus poker pokerroom videopoker slots slotgame megaslots jackpot jackpots roulette liveroulette bet bets betting sportsbet gamble gambling gambler "
    "viagra cheapviagra pill pills dietpills pillshop steroid steroids adult adultchat adultvideo xxx xxxvideo porn porno dating sexdating webcam webcams escort escorts "
    "warez warezsite crack cracked crackz keygen keygens torrent torrents payday paydayloan loan loans quickloan verify verifylogin loginverify prize prizes winprize "
    "ads adserver adtrack popads popup popups spam spammer spambot linkfarm linkfarms backlink backlinks clickbait clickads"
).split()
EVERYDAY = (
    "library river news weather science garden history museum mathematics cooking home train school travel guide radio archive health institute book shop university hospital info "
    "encyclopedia trail walk theatre house community forum film review photo club reader farmers market network engineering nation statistics language space music lesson tribune "
    "orchestra water authority climate data nature reserve software manual tutorial electronics town council parliament member bank football league winter sport advice "
    "address method kitchen planet letter better linked advance admin adventure education skill spillway create cracker package keyboard loaned clicker"
).split()
GROUPS = "the ing and ion tion ent ati for her ter ere ate con res ver all ons nce men ith ted ers pro thi are ess ive ect rea com per int est sta ica ist ear ain one our iti rat ble ther sh tr".split()
TELLING = (
    "wiki article articles about docs blog/post research course library/catalogue recipes events news/local help reports lecture people".split(),
    "bonus play-now bet/live free-spins buy-cheap no-prescription xxx/video hot/chat download/crack serial/keygen torrent/get apply-loan verify/account claim-prize ads/click buy/backlinks".split(),
)
ENDINGS = "com net org example.com example.net example.org".split()
SUBDOMAINS = ("", "www.", "m.", "blog.")
LANGUAGES = "en de fr es".split()
AROUND = "my the best free online first new top".split()


def _spelled(word: str, j: int) -> str:
    """The word, or one of its usual disguises: a digit for a letter, a repeated letter, a cut."""
    return (word, word.replace("o", "0", 1).replace("i", "1", 1), word, word[:-1] + 2 * word[-1], word, word[:2] + "-" + word[2:] if len(word) > 5 else word)[j % 6]


def labelled_words(each: int = 8) -> list[tuple[str, str, int]]:
    """(word, url, label): `each` urls for each unwanted word, each everyday word, and as many names as there are letter groups."""
    out = []
    names = ["".join(GROUPS[(i * k + k) % len(GROUPS)] for k in (1, 7, 18)[: 2 + i % 2]) for i in range(len(GROUPS))]
    for label, words in ((1, UNWANTED), (0, EVERYDAY + names)):
        for i, word in enumerate(words):
            for j in range(each):
                other, around = EVERYDAY[(5 * i + 17 * j + 3) % len(EVERYDAY)], AROUND[(i + 3 * j) % len(AROUND)]
                said = _spelled(word, i + j) if label else word
                name = (f"{said}-{other}", f"{around}-{said}", f"{around}{said}", said, f"{said}{other}", f"{said}-{around}", f"{other}-{said}", f"{said}{i % 10}")[j % 8]
                host = SUBDOMAINS[(i + j) % 4] + name + "." + ENDINGS[(i + 2 * j) % len(ENDINGS)]
                number = (31 * i + 97 * j) % 9973
                page = f"{LANGUAGES[(i + 3 * j) % 4]}/{number}" if (i + j) % 2 else f"{TELLING[label][(i + 5 * j) % len(TELLING[label])]}/{number % 89}"
                out.append((word, f"http{'s' * (j % 2)}://{host}/{page}{('', '/', '.html', '?page=2')[(i + j // 2) % 4]}", label))
    return sorted(set(out))


def url_labels(each: int = 8) -> list[tuple[str, int]]:
    """(url, label) of all words."""
    return sorted({(url, label) for _, url, label in labelled_words(each)})
