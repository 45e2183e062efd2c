"""The small labelled URL table from which the URL model learns.

Judged by hand, by what host and path say of a page: adverts and trackers, gambling, pornography, fake
medicine and goods, loans and prizes, stolen software and malware are junk. Many junk pages stand on plain
hosts, where only the path tells, and many plain URLs hold letters of junk words. HELD_OUT is never learnt.
"""

# Labelled by hand.
JUNK = """
www.casino-royal.example.org /en/bonus
lucky-casino.net /play
casino777.biz /de/slots/free-spins
bigwin-slots.com /
pokerstars-bonus.info /register
online-poker-room.net /es/
bet-on-sports.example.com /odds
livebets.example.org /fr/2210
betting-tips24.com /today
jackpot-lottery.co /winner
win-a-prize.example.net /claim?id
winbig.example.com /en/7
freegift-cards.info /get
free-money-now.biz /start
free-spins.example.org /4411
sportbets.ru /line/live
xxx-tube.net /videos/11
freeporn.example.com /en/4
porn-clips.org /watch/882
hotcams.example.net /adult/room
adult-dating.example.org /de/900
adultshop.example.com /dvd
sexy-girls.ru /gallery
sexchat.example.com /
x-rated.example.net /fr/17.html
escort-service.biz /city/berlin
milf-movies.com /hd
nude-pics.info /album/3
cheap-viagra.example.org /order
buy-cialis.net /no-prescription
canadian-pills.com /discount
pillshop.example.net /en/31
cheapmeds.example.com /pills/blue
weightloss-pills.biz /order-now
cheap-watches.ru /replica/rolex
replica-bags.example.org /sale
cheap-jerseys.cn /nfl
payday-loans.example.net /apply
fastcash-loan.biz /en/
debt-free-quick.info /loan
ads.example.com /banner/728x90
adserver.example.net /click/99
ad-track.example.org /pixel.gif
tracker.example.com /hit/1
trackads.biz /r/
popads.example.org /de/201
click-exchange.net /in
doubleads.ru /show
clickfarm.example.com /en/65
linkfarm.example.net /page/12
seo-link-farm.info /directory
spammer-tools.biz /bulk-mail
spam.example.org /fr/1200
bulkspam.example.com /list
malware-drop.ru /setup.exe
phish-login.example.net /paypal/verify
warez-zone.org /full
crackz.example.com /keygen
torrent-leech.example.net /movies/cam
fake-id-shop.biz /passport
www.site.example.org /porn/videos/3
github.io /user/xxx/index.html
pages.example.com /~jo/porn.html
blog.city.example.net /2019/01/buy-viagra-online
forum.garden.example.org /profile/online-casino-bonus
wiki.school.example.com /user:cheap-pills
docs.river.example.org /casino/free-slots
shop.stone.example.net /adult/xxx-dvd
m.photo.example.com /nude/hot-girls
news.lake.example.org /ads/click/5521
static.paper.example.net /banner/track.gif
media.north.example.com /tracking/pixel/1
old.church.example.org /wp-content/viagra-cialis
library.town.example.net /redirect/poker-online
my.college.example.com /~x/sex-videos
board.music.example.org /topic/payday-loan-fast
www.hotel.example.net /spam/links/11
files.street.example.com /warez/keygen.zip
upload.valley.example.org /crack/serial-key
www.farmers.example.com /bets/football-odds
img.museum.example.net /popup/adserve
guest.book.example.org /replica-watches-cheap
user.host.example.com /escorts/night
a.b.example.net /lottery/winner-claim
mail.form.example.com /phishing/login-verify
"""
PLAIN = """
www.city-library.example.org /en/catalogue
museum.example.com /de/exhibitions/2020
en.wikipedia.org /wiki/River
de.wikipedia.org /wiki/Stadt
github.com /python/cpython/issues/11
stackoverflow.com /questions/1732348
news.bbc.co.uk /2/hi/science/
www.nytimes.com /2020/03/01/world/europe
www.lemonde.fr /politique/article
www.spiegel.de /wissenschaft/mensch
elpais.com /cultura/2021
www.who.int /news-room/fact-sheets
www.nasa.gov /missions/apollo
arxiv.org /abs/1706.03762
www.sussex.ac.uk /study/masters
middlesex.edu /history/index.html
www.wessex-archaeology.co.uk /reports
unisex-fashion.example.org /spring
sextant-sailing.org /navigation
www.pokedex.example.net /list/25
poker-flat-research.alaska.edu /range
alphabet.example.com /letters/a
betty-cooks.example.org /recipes
bethlehem.edu /courses
tibet-travel.example.net /lhasa
diabetes.example.org /insulin/guide
better-homes.example.com /garden
pillow-makers.example.net /cotton
caterpillar-watch.org /moths
spillway.example.com /dams/9
loans-of-art.museum.example.org /policy
sloan.mit.edu /faculty
adsorption.chem.example.edu /papers
roadside-geology.example.org /maps
heads-up-football.example.net /safety
trade-school.example.com /welding
racetrack-history.example.org /ovals
track-and-field.example.net /results/2019
soundtrack.example.com /albums/film
railway-tracks.example.org /gauge
adulthood-study.example.edu /survey
adult-education.example.org /evening-classes
freedom-archive.example.net /speeches
free-software.example.org /gnu
freeland-farm.example.com /visit
windmill.example.net /holland
window-repair.example.com /de/4210
winter-sports.example.org /ski/88
wine-country.example.net /fr/2207
cheapside-street.example.org /london
cheaper-by-rail.example.net /timetable
cocktail-recipes.example.com /classic
peacocks.example.org /birds
analytics-course.example.edu /week/3
canal-boats.example.net /routes
therapist-directory.example.org /find
grapefruit.example.com /breakfast
scunthorpe.example.co.uk /council
shiitake.example.net /mushrooms
saxophone.example.org /lessons/2
exxon-valdez.history.example.com /spill
farm-museum.example.org /en/31
organic-farm.example.com /es/visit
span-bridge.example.net /engineering
spanish-lessons.example.org /es/12
parmesan.example.com /cheese
click-beetles.example.org /insects
popular-science.example.net /en/7712
pop-music.example.com /charts/1985
slotted-screws.example.net /hardware
camera-club.example.org /gallery
campus.example.edu /de/studium
cambridge-school.example.com /fr/331
casinobuilding-heritage.example.org /architecture
cassini.example.net /saturn
malware-research.example.edu /papers/2018
torrential-rain.example.org /weather
crackers-and-cheese.example.com /recipes
mirror.example.org /debian/pool/main
blog.river.example.com /2021/05/spring-walks
blog.tanner.example.net /en/2112
blog.handson.example.org /de/451
m.weather.example.com /today
m.station.example.net /fr/8516
m.hearth.example.org /en/66
www.there-and-back.example.com /es/903
www.earthen.example.org /en/5020.html
www.nation.example.net /de/77/
nationwide.example.org /en/310
thatching.example.com /en/7053
thunder.example.net /fr/3808/
another.example.org /de/9667
gathering.example.com /en/445
author-house.example.net /es/2276
weathered.example.org /en/839
forum.example.com /t/how-to-bake-bread/9912
docs.example.org /api/v2/reference.html
shop.example.net /products/oak-table
support.example.com /articles/reset-a-clock
photos.example.org /albums/summer/12
video.example.net /watch/lecture-4
archive.example.com /1997/index.htm
jobs.example.org /de/ingenieur
schule.example.net /stundenplan
biblioteca.example.com /es/libros
mairie.example.org /fr/horaires
"""
HELD_OUT_JUNK = """
github.io /x/porn/videos
news.site.org /xxx-videos/1
best-casino.example.net /en/12
poker-bonus.example.org /
free-slots.example.com /de/80
hot-porn.example.net /fr/5
pill-discount.example.org /viagra
cheap-loans.example.com /payday
adtracker.example.net /click
spam-links.example.org /en/40
sex-videos.example.com /hd
blog.winter.example.org /casino-bonus-free
www.bakery.example.net /cheap-viagra-pills
wiki.ocean.example.com /online-poker
lottery-winner.example.net /claim
replica-rolex.example.com /watches
sport-bets.example.org /odds/live
ads-banner.example.com /track/1
adult-cams.example.net /room/8
keygen-warez.example.org /crack
"""
HELD_OUT_PLAIN = """
pokemon-fans.org /
essex.ac.uk /history
spokane.example.com /news
alphabetical.example.net /order
betterment.example.org /en/4
caterpillars.example.com /garden
winnipeg.example.net /travel
essexlibrary.example.org /books
soundtracks.example.net /film/2
swindon.example.co.uk /station
addison.example.com /school
madrid.example.org /es/museo
university.example.edu /faculty
kitchen.example.net /de/9
country-walks.example.org /fr/77
photography.example.com /lessons
blog.further.example.net /en/2112
m.bother.example.com /de/7
www.lathen.example.org /es/15
stationer.example.net /en/1001
ocean-science.example.com /papers
village.example.org /mairie
computer-history.example.net /1984
adsorbent.example.edu /chemistry
"""


def read(text: str, allow: bool) -> list[tuple[str, str, bool]]:
    return [(*line.split(" ", 1), allow) for line in text.split("\n") if line]


def learnt() -> list[tuple[str, str, bool]]:
    """Rows (host, path, allow); what has neither host nor path speaks against nothing, so it is plain."""
    return read(JUNK, False) + read(PLAIN, True) + [("", "", True)]


def held_out() -> list[tuple[str, str, bool]]:
    return read(HELD_OUT_JUNK, False) + read(HELD_OUT_PLAIN, True)
