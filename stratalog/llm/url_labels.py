"""The default labelled URL table: whole URLs, made up for this purpose."""

from __future__ import annotations

# URLs of sites that are to be blocked.
BLOCK = """
http://royal-casino-bonus.com/en/12
https://blog.casino-jackpot-win.example.com/news/2021
https://m.lucky-casino.org/en/453
http://www.win-big-casino.example.org/list/3
https://online-poker-bets.net/
https://blog.poker-win-cash.example.net/archive
http://m.free-bets-today.com/go
https://www.sports-bets-live.example.com/es/77/
https://best-betting-tips.org/index.html
http://blog.bingo-bonus-win.example.org/en/231#top
https://m.freespins-slots.net/de/5.html
https://www.cheap-pills-online.example.net/en/8?page=2&ref=x
http://cheap-meds-pharmacy.com/de/88?utm_source=feed
https://blog.discount-viagra.example.com/fr/340
https://m.buy-cialis-cheap.org/about
http://www.diet-pills-fast.example.org/item/9
https://miracle-pills.net/en/12
https://blog.replica-watches-cheap.example.net/news/2021
http://m.cheap-bags-outlet.com/en/453
https://www.payday-loans-fast.example.com/list/3
https://easy-cash-loan.org/
http://blog.quick-money-loans.example.org/archive
https://m.make-money-fast.net/go
https://www.crypto-double-profit.example.net/es/77/
http://free-gift-cards-win.com/index.html
https://blog.spam-links-farm.example.com/en/231#top
https://m.link-farm-seo.org/de/5.html
http://www.spam-mailer.example.org/en/8?page=2&ref=x
https://seo-spam-network.net/de/88?utm_source=feed
https://blog.content-farm-clicks.example.net/fr/340
http://m.ads-server-track.com/about
https://www.track.example.com/item/9
https://banner-ads-click.org/en/12
http://blog.ads-track-pixel.example.org/news/2021
https://m.adclick-tracker.net/en/453
https://www.popup-ads-win.example.net/list/3
http://xxx-videos-tube.com/
https://blog.adult-cams-live.example.com/archive
https://m.porn-free-tube.org/go
http://www.sex-dating-hot.example.org/es/77/
https://adult-xxx-club.net/index.html
https://blog.hot-escorts-city.example.net/en/231#top
http://m.warez-crack-keygen.com/de/5.html
https://www.free-cracks-serial.example.com/en/8?page=2&ref=x
https://torrent-warez-hub.org/de/88?utm_source=feed
http://blog.download-free-keygen.example.org/fr/340
https://m.clickbait-shock-news.net/about
https://www.win-free-phone-now.example.net/item/9
http://lottery-winner-claim.com/en/12
https://blog.free-prize-draw-win.example.com/news/2021
""".split()

# URLs of sites that are to be allowed.
ALLOW = """
http://northern-herald.com/en/12
https://blog.thereader.example.com/news/2021
https://m.weather-station.org/en/453
http://www.theatre-of-the-north.example.org/list/3
https://health-research.net/
https://blog.earth-history.example.net/archive
http://m.nation-and-state.com/go
https://www.otherwise-journal.example.com/es/77/
https://mathematics-letters.org/index.html
http://blog.method-and-theory.example.org/en/231#top
https://m.thames-rowing.net/de/5.html
https://www.the-gardener.example.net/en/8?page=2&ref=x
http://orchard-farm.com/de/88?utm_source=feed
https://blog.evening-post.example.com/fr/340
https://m.morning-tribune.org/about
http://www.learning-languages.example.org/item/9
https://engineering-notes.net/en/12
https://blog.teaching-physics.example.net/news/2021
http://m.university-press.com/en/453
https://www.city-library.example.com/list/3
https://museum-of-printing.org/
http://blog.county-archive.example.org/archive
https://m.parish-records.net/go
https://www.river-and-forest.example.net/es/77/
http://mountain-hiking.com/index.html
https://blog.cycling-routes.example.com/en/231#top
https://m.sailing-weather.org/de/5.html
http://www.kitchen-table.example.org/en/8?page=2&ref=x
https://village-bakery.net/de/88?utm_source=feed
https://blog.wheat-and-barley.example.net/fr/340
http://m.symphony-orchestra.com/about
https://www.painting-and-drawing.example.com/item/9
https://gallery-north.org/en/12
http://blog.fiction-review.example.org/news/2021
https://m.the-observer-blog.net/en/453
https://www.daily-standard.example.net/list/3
http://ethnography-today.com/
https://blog.rhythm-and-sound.example.com/archive
https://m.bird-watching.org/go
http://www.lighthouse-trust.example.org/es/77/
https://information-science.net/index.html
https://blog.education-station.example.net/en/231#top
http://m.translation-notes.com/de/5.html
https://www.conservation-area.example.com/en/8?page=2&ref=x
https://action-research.org/de/88?utm_source=feed
http://blog.national-statistics.example.org/fr/340
https://m.the-weekly-letter.net/about
https://www.southern-gazette.example.net/item/9
http://railway-timetable.com/en/12
https://blog.anthology-of-verse.example.com/news/2021
https://m.animal-hospital.org/en/453
http://www.children-and-reading.example.org/list/3
https://winter-garden.net/
https://blog.house-and-hearth.example.net/archive
http://m.open-data-portal.com/go
https://www.astronomy-tonight.example.com/es/77/
https://the-history-of-tea.org/index.html
http://blog.foreign-affairs-notes.example.org/en/231#top
https://m.shorthand-teachers.net/de/5.html
https://www.anderson-and-sons.example.net/en/8?page=2&ref=x
http://weather.com/de/88?utm_source=feed
https://blog.therapy-centre.example.com/fr/340
https://m.northern-theatre.org/about
http://www.earthquake-research.example.org/item/9
https://heather-and-thyme.net/en/12
https://blog.thunder-bay.example.net/news/2021
http://m.the-thistle.com/en/453
https://www.tenth-avenue-theatre.example.com/list/3
https://thread-and-thimble.org/
http://blog.thatcher-and-son.example.org/archive
https://m.other-thoughts.net/go
https://www.birth-registry.example.net/es/77/
http://seventh-station.com/index.html
https://blog.nation-and-region.example.com/en/231#top
https://m.relation-and-motion.org/de/5.html
http://www.station-heritage.example.org/en/8?page=2&ref=x
https://theorem-notes.net/de/88?utm_source=feed
https://blog.rather-than.example.net/fr/340
http://m.gathering-place.com/about
https://www.feather-and-fern.example.com/item/9
https://another-country.org/en/12
http://blog.ontario-trails.example.org/news/2021
https://m.interior-therapist.net/en/453
https://www.thorn-and-heath.example.net/list/3
http://fourth-edition.com/
https://blog.ration-book.example.com/archive
https://m.edition-and-translation.org/go
http://www.threshold-theatre.example.org/es/77/
https://southern-heritage.net/index.html
https://blog.leather-goods.example.net/en/231#top
http://m.brother-typewriters.com/de/5.html
https://www.there-and-back.example.com/en/8?page=2&ref=x
https://reheated-stories.org/de/88?utm_source=feed
http://blog.the-other-reader.example.org/fr/340
https://m.hermitage-notes.net/about
https://www.toronto-weather.example.net/item/9
""".split()
