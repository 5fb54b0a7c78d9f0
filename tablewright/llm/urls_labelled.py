"""Hand-written part of the labelled url table: hosts and paths of many makes, by kind.

Every word below is one url; a kind is what a test holds out as a whole.
"""

from __future__ import annotations

UNWANTED = {
    "gambling": """
        https://www.bet365.com/ https://www.pokerstars.com/download/ https://www.888casino.com/games https://www.williamhill.com/betting
        https://betway.com/en/ https://www.unibet.com/betting/odds https://www.ladbrokes.com/ https://www.paddypower.com/bet
        https://www.draftkings.com/sportsbook https://sportsbook.fanduel.com/ https://www.betfair.com/exchange/ https://1xbet.com/en/live/
        https://www.bovada.lv/casino https://stake.com/casino/home https://www.leovegas.com/slots https://www.partypoker.com/
        https://megaslots.biz/free-spins https://luckyjackpot777.com/ https://royal-roulette.net/bonus https://onlinebingo.co/deposit
        https://bestodds.bet/tips https://casino-bonuses.info/no-deposit https://slotking.win/play https://blackjackvip.casino/
        https://wettbonus24.de/wetten https://spielautomaten-gratis.de/ https://parissportifs-bonus.fr/ https://apuestas-en-linea.es/
        https://lotto-winner.org/results-hack https://www.betsson.com/en https://bet-at-home.com/en/sport https://www.bwin.com/
    """,
    "adult": """
        https://www.pornhub.com/ https://www.xvideos.com/ https://xhamster.com/videos https://www.xnxx.com/search/ https://www.youporn.com/
        https://www.redtube.com/ https://onlyfans.com/model https://chaturbate.com/female-cams/ https://www.brazzers.com/ https://www.playboy.com/gallery
        https://stripchat.com/girls https://www.livejasmin.com/en/ https://spankbang.com/trending https://www.tube8.com/hardcore
        https://hotsexvideos.net/milf https://nudegirls.pics/ https://xxxcams.live/room https://eroticstories.club/ https://freeporn.tv/amateur
        https://escort-ladies.biz/city https://sexdating24.com/join https://adultfinder.net/profiles https://hookup-tonight.com/signup
        https://erotik-chat.de/ https://porno-gratuit.fr/videos https://cams18.com/nude https://hentai-haven.xxx/watch https://fetishclub.org/gallery
    """,
    "medicine": """
        https://cheap-viagra-online.biz/ https://buy-cialis.net/order https://rxpills24.com/no-prescription https://canadian-pharmacy-meds.com/
        https://discount-xanax.top/buy https://tramadol-shop.ru/ https://levitra-generic.info/ https://steroids4u.to/shop https://dietpills.store/fast
        https://miracle-weightloss.club/keto-pills https://cheapmeds.cc/cart https://ambien-overnight.com/ https://oxycontin.cheap/
        https://penis-enlarge.biz/ https://kamagra-kaufen.de/ https://viagra-sans-ordonnance.fr/ https://comprar-viagra.es/ https://hgh-injections.net/
        https://modafinil-cheap.org/order https://pharmacy-discount.top/pills
    """,
    "adverts": """
        https://ad.doubleclick.net/click https://ads.pubmatic.com/AdServer https://www.googleadservices.com/pagead/aclk https://adclick.g.doubleclick.net/pcs/click
        https://track.adform.net/C/ https://secure.adnxs.com/clktrb https://cdn.taboola.com/libtrc https://widgets.outbrain.com/outbrain.js
        https://popads.net/ https://go.propellerads.com/afu.php https://adfly.link/banner https://trk.clickbank.net/hop https://pixel.quantserve.com/pixel
        https://b.scorecardresearch.com/beacon https://banners.trafficjunky.net/ https://adserver.exoclick.com/ads https://ads.yieldmo.com/
        https://pop.cash/ https://clicktracker.site/redirect https://affiliate-banner.net/aff https://sponsored-links.biz/click
        https://doubleclicks.info/adserve https://metrics.tracker.io/collect
    """,
    "piracy": """
        https://thepiratebay.org/search https://www.1337x.to/torrent https://rarbg.to/torrents.php https://fmovies.to/watch https://123movies.la/
        https://warez-bb.org/ https://crackedsoft.net/keygen https://serials.ws/crack https://nulled.to/leaks https://kickasstorrents.cr/
        https://getintopc-crack.com/activator https://freekeygen.net/serial-number https://yts.mx/torrent-download https://moviestream-free.cc/full-hd
        https://roms-download.cc/iso https://apk-mod-hack.com/unlimited https://windows-activator.net/kms https://leakedfiles.to/
    """,
    "loans and tricks": """
        https://payday-cash-now.com/apply https://fast-loans-bad-credit.biz/ https://quickcash.loan/instant https://forex-signals-profit.com/
        https://bitcoin-doubler.top/invest https://earn-money-fast.club/ https://crypto-giveaway.live/elon https://make-money-online.biz/secret
        https://free-iphone-winner.win/claim https://survey-rewards.xyz/gift-card https://paypal-secure-login.tk/verify https://appleid-verify.cf/account/login
        https://bank-account-update.ga/signin https://amazon-prize.gq/winner https://microsoft-support-alert.ml/virus https://freegiftcards.top/generator
        https://replica-watches.ru/rolex https://cheap-handbags-outlet.cn/replica https://essay-writing-cheap.com/buy-essay https://buy-followers.club/instagram
        https://seo-backlinks.top/buy-links https://kredit-ohne-schufa.de/sofort https://credit-rapide.fr/ https://spamlist.biz/emails https://hacktool.zip/malware
        https://singles-in-your-area.com/ https://russian-brides.net/meet https://psychic-hotline.biz/ https://getrichquick.win/
    """,
    "subdomains": """
        http://casino.example.org/ http://cheap-meds.example.com/en/3 https://porn.example.net/a http://free-slots.example.com/ https://adclicks.example.org/x
        http://spammers.example.net/de/ http://link-spam.example.com/p https://warez.example.org/fr/2 http://pokerclub.example.net/ https://xxx.example.com/en/
        http://betting-tips.example.org/a/b http://replica-shop.example.net/1 https://escorts.example.com/ http://keygens.example.org/en/ http://payday.example.net/
        https://www.slots.example.de/ https://www.pills-shop.co.uk/en/7 http://torrentz.example.fr/index.html http://spam-links.info/ https://www.freeslots.net/
        https://www.slotmachines.com/ http://slots-online.co.uk/ https://linkfarm-spam.biz/ http://megacasino.co/ https://mega-jackpots.org/ http://www.pillstore.net/
    """,
    "paths": """
        https://www.lakeside.org/casino/online-slots https://forum.hillview.net/buy-viagra-cheap https://blog.marten.com/porn/videos/1 https://sites.example.edu/~tim/warez/crack.html
        https://www.oakfield.co.uk/wp-content/poker-bonus https://news.riverbank.info/adclick?id=1 https://files.server7.net/keygen/photoshop-crack https://www.baxter.fr/xxx/nude
        https://shop.alder.de/cheap-pills/order https://www.quarry.es/payday-loans/apply-now https://m.bellamy.com/free-spins-no-deposit https://hugo.wordpress.com/hot-singles-near-you
        https://www.mill-house.org/escorts/london https://old.dunstan.net/torrent/download/movie https://www.tarn.io/phishing/login-verify https://pages.harrow.com/win-a-prize/claim
        https://ash.github.io/malware/exe https://www.ferry.net/replica-watches/rolex https://en.corin.org/sex/cams https://www.fenwick.info/bet/odds/football-tips
        https://www.stow.com/gambling/roulette-strategy https://x.glen.net/banner-ads/popunder https://www.dale.de/viagra-kaufen https://www.moor.fr/casino-en-ligne
        https://groups.birch.org/spam/bulk-email https://mirror.elm.net/serials/crack-keygen https://www.heath.com/adult/gallery https://www.croft.org/steroids/buy-online
    """,
}

ORDINARY = {
    "programming": """
        https://docs.python.org/3/library/functions.html https://docs.python.org/3/tutorial/ https://developer.mozilla.org/en-US/docs/Web https://stackoverflow.com/questions/11227809
        https://github.com/torvalds/linux https://gitlab.com/explore https://pypi.org/project/numpy/ https://www.npmjs.com/package/react https://doc.rust-lang.org/book/
        https://go.dev/doc/effective_go https://en.cppreference.com/w/cpp/container https://kubernetes.io/docs/home/ https://spark.apache.org/docs/latest/ https://www.postgresql.org/docs/
        https://readthedocs.org/projects https://learn.microsoft.com/en-us/dotnet https://docs.oracle.com/javase/tutorial https://www.gnu.org/software/bash/manual/ https://wiki.archlinux.org/title/Installation
        https://numpy.org/doc/stable/reference https://pandas.pydata.org/docs/user_guide https://api.rubyonrails.org/classes https://www.php.net/manual/en https://kotlinlang.org/docs/basic-syntax.html
        https://www.kernel.org/doc/html https://redis.io/commands https://sqlite.org/lang.html https://regex101.com/library https://leetcode.com/problems/two-sum
    """,
    "knowledge": """
        https://en.wikipedia.org/wiki/Suffix_array https://de.wikipedia.org/wiki/Berlin https://www.britannica.com/topic/history https://plato.stanford.edu/entries/kant/ https://arxiv.org/abs/1706.03762
        https://www.nature.com/articles/d41586 https://www.sciencedirect.com/science/article https://pubmed.ncbi.nlm.nih.gov/31452104 https://www.jstor.org/stable/2346 https://scholar.google.com/citations
        https://www.gutenberg.org/ebooks/1342 https://archive.org/details/texts https://www.khanacademy.org/math/algebra https://ocw.mit.edu/courses https://www.coursera.org/learn/machine-learning
        https://www.loc.gov/collections https://www.bl.uk/manuscripts https://www.harvard.edu/about https://www.ox.ac.uk/admissions https://www.uni-heidelberg.de/de/forschung
        https://www.cnrs.fr/fr/recherche https://www.csic.es/es/investigacion https://www.merriam-webster.com/dictionary https://www.duden.de/rechtschreibung/Haus https://www.larousse.fr/dictionnaires
        https://dle.rae.es/palabra https://mathworld.wolfram.com/Prime.html https://www.wolframalpha.com/examples https://www.nasa.gov/missions https://www.esa.int/Science
    """,
    "news": """
        https://www.bbc.co.uk/news/world https://www.theguardian.com/books https://www.nytimes.com/section/science https://www.reuters.com/world https://apnews.com/article
        https://www.lemonde.fr/international https://www.spiegel.de/politik https://elpais.com/cultura https://www.zeit.de/wissen https://www.liberation.fr/culture
        https://www.washingtonpost.com/opinions https://www.economist.com/briefing https://www.npr.org/sections/news https://www.aljazeera.com/features https://www.faz.net/aktuell/feuilleton
        https://www.theatlantic.com/magazine https://www.elmundo.es/deportes https://www.sueddeutsche.de/muenchen https://www.independent.ie/regionals https://local-gazette.com/council-meeting
        https://www.nzherald.co.nz/nz https://www.abc.net.au/news https://www.cbc.ca/news/canada https://globalnews.ca/weather https://www.latimes.com/travel
    """,
    "public": """
        https://www.gov.uk/browse/benefits https://www.usa.gov/voting https://www.service-public.fr/particuliers https://www.bundesregierung.de/breg-de https://europa.eu/european-union
        https://www.who.int/health-topics https://www.nhs.uk/conditions/asthma https://www.cdc.gov/flu https://www.mayoclinic.org/diseases-conditions https://www.redcross.org/donate
        https://www.un.org/en/about-us https://www.unicef.org/education https://www.worldbank.org/en/country https://www.oecd.org/tax https://data.gov/climate
        https://www.weather.gov/forecast https://www.metoffice.gov.uk/weather https://www.nps.gov/yose https://www.cityofboston.gov/parks https://www.berlin.de/aemter
        https://www.sncf.com/fr/horaires https://www.bahn.de/fahrplan https://www.nationalrail.co.uk/timetables https://www.amtrak.com/train-routes https://www.bvg.de/en/tickets
    """,
    "home and shops": """
        https://www.bbcgoodfood.com/recipes/soup https://www.allrecipes.com/recipe/pancakes https://www.marmiton.org/recettes https://www.chefkoch.de/rezepte https://www.kingarthurbaking.com/bread
        https://www.rhs.org.uk/plants/roses https://www.gardenersworld.com/how-to https://www.ikea.com/gb/en/cat/tables https://www.etsy.com/listing/pottery https://www.ebay.com/itm/lamp
        https://www.amazon.com/dp/B08N5 https://www.decathlon.fr/randonnee https://www.johnlewis.com/curtains https://www.lego.com/en-us/themes https://www.bookshop.org/books
        https://www.tripadvisor.com/Hotels https://www.booking.com/hotel/es https://www.airbnb.com/rooms https://www.lonelyplanet.com/italy https://www.ryanair.com/gb/en
        https://www.goodreads.com/book/show https://www.imdb.com/title/tt0111161 https://www.rottentomatoes.com/m/metropolis https://open.spotify.com/album https://www.youtube.com/watch
        https://www.reddit.com/r/askscience https://medium.com/@writer/story https://www.quora.com/Why-is-the-sky-blue https://www.flickr.com/photos https://soundcloud.com/artist
        https://www.parkrun.org.uk/results https://www.chess.com/openings https://www.fifa.com/worldcup https://www.uefa.com/fixtures https://www.olympics.com/en/sports
    """,
    "small sites": """
        http://thornebury.org/ http://www.smithandsons.co.uk/about https://maryshelleybooks.com/contact https://st-marys-church.org.uk/services https://village-hall-bookings.org/calendar
        https://jonasweber.de/blog/reise https://lapetiteboulangerie.fr/nos-pains https://panaderia-lopez.es/horarios https://old-railway-museum.org/exhibits https://hillsidefarm.com/visit
        https://dr-klein-praxis.de/sprechzeiten https://www.kestrelchoir.org/concerts https://annas-knitting.net/patterns https://northside-school.edu/lessons https://maple-street-dental.com/appointments
        https://cyclingclub-lyon.fr/sorties https://www.bridgewatersailing.org/courses https://thornton.net/essays/on-walking https://rivertheatre.com/season https://beekeepers.org.nz/meetings
        http://example.org/index.html http://www.example.com/page/2 https://host7.example.net/a/b https://alpine-hut.ch/en/rooms https://fieldnotes.blog/2021/05/birds
        https://www.castlewood.info/history https://thorpe.me/cv https://lindenbaum.at/speisekarte https://wren.name/photos https://oldmill.io/prices
        https://thorn-garden.org/roses https://www.thorsten-maler.de/leistungen https://thoreau-society.org/walden https://northern-lights.is/tours https://harthorne.edu/library
        https://www.essexbirds.org.uk/sightings https://www.sussexchess.org/league https://middlesexpress.com/councils https://www.scunthorpe.gov.uk/parks https://pennine-walks.org/routes
        https://spamalot-theatre.org/cast https://analysis-lab.edu/reports https://cockfosters-library.org/hours https://specialist-books.com/catalogue https://alphabet-school.org/letters
    """,
    "subdomains": """
        http://library.example.org/ http://choir.example.com/en/3 https://physics.example.net/a http://free-lessons.example.com/ https://bookclicks.example.org/x
        http://gardeners.example.net/de/ http://link-road.example.com/p https://museum.example.org/fr/2 http://rowingclub.example.net/ https://www.example.com/en/
        http://baking-tips.example.org/a/b http://book-shop.example.net/1 https://elders.example.com/ http://kestrel.example.org/en/ http://friday.example.net/
        https://www.plots.example.de/ https://www.hills-shop.co.uk/en/7 http://forrest.example.fr/index.html http://farm-links.info/ https://www.freewalks.net/
        https://www.washingmachines.com/ http://lessons-online.co.uk/ https://linkedgardens.org/ http://megalith.co/ https://mega-structures.org/ http://www.pillarstone.net/
        http://fern-and-moss.com/ http://grove-street.org/ http://hazelgrove.co.uk/ https://fernwood.edu/courses http://elm-grove-primary.sch.uk/ https://www.olivegrove.gr/menu
    """,
    "no host": """
        nothing untitled index.html about:blank - n/a /index.html page mailto:someone document draft none
    """,
    "paths": """
        https://www.lakeside.org/library/opening-hours https://forum.hillview.net/gardening/roses https://blog.marten.com/travel/videos/1 https://sites.example.edu/~tim/thesis/chapter2.html
        https://www.oakfield.co.uk/wp-content/annual-report https://news.riverbank.info/articles?id=1 https://files.server7.net/manual/photoshop-lessons https://www.baxter.fr/musee/expositions
        https://shop.alder.de/bread/order https://www.quarry.es/horarios/apply https://m.bellamy.com/recipes-with-bread https://hugo.wordpress.com/notes-on-history
        https://www.mill-house.org/rooms/london https://old.dunstan.net/documents/download/minutes https://www.tarn.io/support/login https://pages.harrow.com/school/prize-giving
        https://ash.github.io/physics/notes https://www.ferry.net/timetable/summer https://en.corin.org/choir/concerts https://www.fenwick.info/results/football
        https://www.stow.com/history/chapter-1 https://x.glen.net/maps/walks https://www.dale.de/impressum https://www.moor.fr/contact
        https://groups.birch.org/minutes/2020 https://mirror.elm.net/software/manual https://www.heath.com/education/gallery https://www.croft.org/vegetables/buy-local
    """,
}


def kinds() -> dict[str, list[tuple[str, float]]]:
    """(url, label) of each kind, 1 for an unwanted one."""
    return {
        f"{name} {label}": [(url, float(label)) for url in urls.split()]
        for label, group in ((1, UNWANTED), (0, ORDINARY))
        for name, urls in group.items()
    }
