"""Rules that move scores between categories, and the Turkish profile's rules of context as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """Adds ``deltas`` to category scores of texts that match every pattern of ``must`` and none of ``must_not``.

    ``field``: text (title and body, lower-cased), title or url. Of the rules of one ``group`` only the first match counts.
    ``reset`` names categories whose score becomes 0 after all deltas. ``unless``: pairs of patterns over the text; the
    rule is off where the first of a pair matches and the second does not.
    """

    name: str
    must: tuple[str, ...]
    deltas: tuple[tuple[str, int], ...] = ()
    must_not: tuple[str, ...] = ()
    field: str = "text"
    group: str = ""
    reset: tuple[str, ...] = ()
    unless: tuple[tuple[str, str], ...] = ()


#: News of power that is made (not cut), of cuts as such, of cuts of water.
POWER_MADE = (
    r"elektrik.{0,60}(?:üret|uret|üretti|uretti|üreten|ureten|üretilen|uretilen|üretim|uretim|üretildi|uretildi)|"
    r"(?:üretilen|uretilen|üretim|uretim).{0,40}elektrik|elektrik.{0,40}üretildi|atik.{0,30}elektrik|elektrik.{0,30}atik|"
    r"milyonlarca\s*kwh|milyonlarcakwh|kwh.{0,40}(?:üret|uret|üretti|uretti|kapasite|katkı|kati|karşılan|karsilan)|"
    r"(?:ges\b|güneş\s*(?:enerji|panel|santral)|gunes\s*(?:enerji|panel|santral)|ruzgar\s*türbin|ruzgâr\s*türbin|ruzgar\s*enerji|ruzgâr\s*enerji|"
    r"jeotermal|biyogaz|biyometan|kojenerasyon|chp\b).{0,55}(?:elektrik|kwh|üret|uret|santral|kapasite)|"
    r"(?<![a-zçğıöşü])isu(?![a-zçğıöşü]).{0,55}(?:kwh|elektrik|üret|uret|milyon)|(?:izaydaş|izaydas).{0,55}(?:kwh|elektrik|üret|uret|milyon)"
)
POWER_CUT = (
    r"elektrik\s+kesintisi|enerji\s+kesintisi|programl[ıi]\s+kesinti|planl[ıi]\s+kesinti|plans[ıi]z\s+kesinti|kesinti\s+duyurusu|kesinti\s+listesi|kesinti\s+saatleri|"
    r"kesinti\s+yaşan|kesinti\s+yasan|kesinti\s+yaşayacak|kesinti\s+yasayacak|elektrik\s+kesildi|elektrik\s+kesilecek|elektriksiz|elektrik\s+yok|"
    r"trafo.{0,18}(?:arıza|ariza|patlad|yangın|yangin)|elektrik\s+ne\s+zaman\s+gelecek|abonelerin\s+dikkat|kesinti\s+program"
)
WATER_CUT = (
    r"su\s+kesinti|sular\s+(?:ne\s+zaman|kesilecek|kesildi|gelecek)|su\s+kesilecek|su\s+kesildi|su\s+arızası|su\s+arizasi|"
    r"(?<![a-zçğıöşü])isu(?![a-zçğıöşü]).{0,60}(?:kesinti|su\s+kesilecek|sular)|su\s+kesintisi|sular.{0,30}gelecek|su\s+kesintisi\s+alarm"
)

#: Fixed values from here on: what else a text says, patterns and deltas, in their order.
T, Y, E, H, S, K = "Trafik Kazasi", "Yangin", "Elektrik Kesintisi", "Hirsizlik", "Suc ve Cinayet", "Kulturel Etkinlikler"

FIRE = r"yangın|yangin|itfaiye|alev(?:ler)?|yanan\s|yanmış|yanmis|tutuş|tutus|duman|söndür|sondur|yangına\s+müdahale|yangina\s+mudahale|küle\s+dön|kule\s+don"
CRASH = (
    r"(?:tır|tir|kamyon|otomobil|minibüs|minibus|otobüs|otobus).{0,100}(?:devrilen|devrildi|dorse|çarpış|carpis|çarpıştı|carpisti|altında\s+kaldı|altinda\s+kaldi)|"
    r"(?:tem\b|otoyol|karayolu|tünel|tunel).{0,80}(?:çarpış|carpis|zincirleme|kaza|devrilen|devrildi|araçlar|araclar)"
)
CRIME = (
    r"silahlı\s+saldır|silahli\s+saldir|silahlı\s+saldir|cinayet|eğlence\s+mekan|eglence\s+mekan|gece\s+kulüb|gece\s+kulup|kanlı\s+gece|kanli\s+gece|kurşun\s+yağ|kursun\s+yag|"
    r"zehir\s+tacir|gizli\s+sera|narkotik|uyuşturucu|uyusturucu|ağır\s+suç|agir\s+suc|bar\s+saldır|silah.{0,8}çek|silah.{0,8}cek|"
    r"bıçaklı|bicakli|bıçakladı|bicakladi|bıçakla|bicakla|saldırgan|saldirgan|dehşet\s+an|dehset\s+an|(?:biri|kişi|kisi)\s+öldü|(?:\d+)\s+öl[üu]|ölüme\s+neden|olume\s+neden|"
    r"taksirle\s+öl|taksirle\s+ol|infaz|restoran.{0,30}silah|operasyonla\s+yakalan|katliam|sahte\s+hesap|kesici\s+alet|tecavüz|tecavuz|cinsel\s+saldır|öldürüldü|olduruldu|"
    r"dehşet\s*yaşattı|dehset\s*yasatti|camdan\s+dehşet|camdan\s+dehset"
)
SPORT = (
    r"(?<![a-zçğıöşü])lig(?![a-zçğıöşü])|efeler\s+lig|süper\s+lig|super\s+lig|(?<![a-zçğıöşü])maç(?![a-zçğıöşü])|(?<![a-zçğıöşü])mac(?![a-zçğıöşü])|play[\s-]off|galibiyet|mağlubiyet|maglubiyet|"
    r"(?<![a-zçğıöşü])gol(?![a-zçğıöşü])|futbol|voleybol|basketbol|(?<![a-zçğıöşü])boks(?![a-zçğıöşü])|güreş|gures|atletizm|şampiyon|sampiyon|play\s*off|deplasman|fikstur|fikstür|"
    r"transfer\s+mesai|bonservis|kadro\s+hesab|antrenman|taraftar|tribün|tribun|forvet|defans|kaleci|teknik\s+direktör|[a-zçğıöşü]*spor[a-zçğıöşü]{0,8}(?![a-zçğıöşü])|"
    r"(?<![a-zçğıöşü])turnuva[a-zçğıöşü]{0,6}(?![a-zçğıöşü])|(?<![a-zçğıöşü])u\d{2}(?![a-zçğıöşü])|finalde?\b|yenildi\b|kazandı\b|kazandi\b|beraberlik\b|mağlup\b|maglup\b|"
    r"nerede\s+oynadığ|nerede\s+oynadig|forma\s+giy|sezon.{0,20}performans"
)
TRAFFIC_LAW = (
    r"trafik\s+ceza|fahiş\s+(?:trafik|ceza)|fahis\s+(?:trafik|ceza)|tüvtürk|tuvturk|muayene.{0,25}(?:kural|geçe|gece)|ehliyet\s+(?:kural|sınav|sinav)|"
    r"kasko.{0,30}(?:trafik|sigorta|dönem|donem|sayfa)|trafik\s+sigorta|sigorta.{0,20}(?:yeni\s+dönem|yeni\s+donem|yeni\s+sayfa)|"
    r"trafik.{0,20}(?:düzenleme|duzenleme|kural|yasa|talimat)|(?:ceza|düzenleme|duzenleme).{0,20}talimat"
)
POLITICS = (
    r"iktidara?\s+(?:çağrı|cagri|seslendi)|(?:chp|mhp|ak\s+parti|hdp|iyi\s+parti).{0,40}(?:operasyon|çağrı|cagri)|gelin\s+operasyon\s+yapalım|gelin\s+operasyon\s+yapalim|"
    r"meclis.{0,30}(?:operasyon|soruşturma|sorusturma)|siyasi.{0,20}(?:operasyon|baskı|baski)|muhalefet.{0,30}(?:operasyon|çağrı|cagri)|"
    r"tbmm.{0,40}(?:konuştu|konustu|savunma|strateji)|cumhurbaşkan.{0,30}(?:talimat|düzenleme|duzenleme|imzalad)|teşkilat.{0,30}(?:uyar|duyur|toplandı|toplandi)|"
    r"teskilat.{0,30}(?:uyar|duyur|toplandi)|(?:duyuran|duyurdu|açıkladı|acikladi).{0,30}teşkilat|(?:duyuran|duyurdu|acikladi).{0,30}teskilat|"
    r"(?:saadet\s+partisi|iyi\s+parti|chp|mhp|hdp|ak\s+parti).{0,60}(?:çıkış|cikis|eleştir|elestir|yorum)|"
    r"(?:milletvekili|vekil|genel\s+başkan|genel\s+baskan).{0,40}(?:yorum|değerlendir|degerlendird|konuş|konus)|cumhurbaşkan.{0,40}(?:açılış|acilis|proje|ziyaret)|"
    r"(?:türkkan|turkkan|gergerlioğlu|gergerlioglu|tipioğlu|tipioglu).{0,50}(?:yorum|değerlendir|degerlendird|konuş|konus|çıkış|cikis)|"
    r"(?:değerlendir|degerlendird).{0,40}(?:konuklar|tv'de|tvde|programı|programi)|(?:konuklar|tv).{0,30}(?:değerlendir|degerlendird)|nato\b|eyy\s+amerika|ey\s+amerika|"
    r"(?:bakan\b|bakanı\b|bakani\b).{0,50}(?:ziyaret|geliyor|açıkladı|acikladi|konuştu|konustu)|valilik|milletvekili|ilçe\s+başkan|ilce\s+baskan|belediye\s+başkan|belediye\s+baskan|"
    r"pazarcılar\s+odası|pazarcilar\s+odasi|hayırlı\s+olsun\s+ziyaret|hayirli\s+olsun\s+ziyaret|saadet.{0,30}ziyaret|chp.{0,25}ziyaret"
)
POWER_MADE_TOO = (
    r"elektrik.{0,55}(üret|uret|üretti|uretti|üreten|ureten)|üretilen.{0,30}elektrik|elektrik.{0,40}üretildi|atik.{0,25}elektrik|elektrik.{0,25}atik|"
    r"milyonlarca\s*kwh|kwh.{0,25}(üret|uret|karşılan|karsilan|üretti)"
)
#: Words of theft, in the widths that different rules ask for.
THEFT = r"hırsız|hirsiz|soygun|çalındı|calindi"
THEFT_SNATCH = r"hırsız|hirsiz|soygun|çalındı|calindi|kapkaç|kapkac"
THEFT_WHOLE = r"hırsızlık|hirsizlik|hırsız\b|hirsiz\b|soygun|çalındı|calindi"
SUPPLIER = r"sedaş|sedas|gedaş|gedas"
SHOW = r"konser|festival|sergi|tiyatro|sahne"
ALL = (T, Y, E, H, S, K)

CONTEXT_RULES = (
    Rule("R1 crash without fire", (CRASH,), ((Y, -450), (T, 28)), (FIRE,)),
    Rule("R2 water cut", (WATER_CUT,), ((E, -500),)),
    Rule("R3 without a cut", ("kesintisiz",), ((E, -100),)),
    Rule("R4 power made", (POWER_MADE,), ((E, -500),), (POWER_CUT,), group="power made"),
    Rule("R4 power made too", (POWER_MADE_TOO,), ((E, -120),), group="power made"),
    Rule("R5 price of power", (r"(elektrik|enerji|doğalgaz|dogalgaz).{0,40}(zam|tarife|fiyat|sinyali)|zam\s+sinyali|doğalgaza\s+zam|dogalgaza\s+zam",), ((E, -120),)),
    Rule("R6 jobs", (r"istihdam|i̇stihdama|istihdama|iş\s+kur|is\s+kur|istihdama\s+kesintisiz",), ((E, -80),)),
    Rule("R7 supplier's union", (r"(sedaş|sedas|gedaş|gedas).{0,80}(toplu\s+sözleşme|toplu\s+sozlesme|sendika|grev|işçi|isci|tes-iş|tes-is|zam\s+talebi|maaş|maas)",), ((E, -500),)),
    Rule("R8 dams", (r"baraj|sapanca|yuvacık|yuvacik|içme\s+suyu|icme\s+suyu|arıtma|aritma|su\s+projesi|su\s+projeler|su\s+şebekesi|su\s+sebekesi",), ((E, -380), (Y, -220), (K, -120))),
    Rule(
        "R9 finance",
        (r"(?<![a-zçğıöşü])(?:altın|altin)(?![a-zçğıöşü])|döviz|doviz|borsa|faiz|merkez\s+bank|dolar\s+kuru|euro\s+kuru|sterlin|tahmin|yatırım|yatirim|ekonomist|gramı|grami|ons|beklenti|piyasa|"
         r"çeyrek|ceyrek|bitcoin|fon\b|temettü|temettu|bddk|spk\b",),
        ((T, -160), (K, -200), (S, -100)),
    ),
    Rule("R10 military service", (r"bedelli\s+askerlik|askerlik\s+ücreti|askerlik\s+ucreti|celp\s+dönemi|celp\s+donemi",), ((K, -450), (T, -350), (Y, -350), (E, -350), (H, -350), (S, -280))),
    Rule(
        "R11 electric shock", (r"elektrik\s+akımı|elektrik\s+akimi|akıma\s+kapıl|akima\s+kapil|elektrik\s+çarpması|elektrik\s+carpmasi|elektrik\s+çarptı|elektrik\s+carpti",),
        ((E, -300), (T, -360), (H, -420)),
    ),
    Rule("R12 school bus", (r"servis\s+kazası|servis\s+kazasi|okul\s+servis",), ((T, 42), (H, -350))),
    Rule("R13 crime", (CRIME,), ((T, -120),)),
    Rule("R14 crime without theft", (CRIME,), ((H, -100),), (r"hırsızlık|hirsizlik|hırsız\b|hirsiz\b|soygun|kapkaç|kapkac|çalındı|calindi|market\s+soygun",)),
    Rule(
        "R15 politicians held", (r"gözaltı|gozalti", r"başkan\b|baskan\b|belediye|chp\b|ak\s+parti|maaşlı|maaslı|sevgili"), ((H, -120),),
        (r"hırsız|hirsiz|soygun|çalındı|calindi|kapkaç|kapkac|hırsızlık|hirsizlik",),
    ),
    Rule("R16 released", (r"tahliye\s+edildi|tahliye\s+oldu|tahliyesine\s+karar",), ((H, -200),), (THEFT,)),
    Rule("R17 traffic law", (TRAFFIC_LAW,), ((T, -200),), (r"kaza(?!nır|ndır|nan|nma)|çarptı|carpti|yaralı|yarali|devrildi|takla",)),
    Rule(
        "R18 road works",
        (r"proje\s+onay|proje.{0,20}onaylandı|proje.{0,20}onaylandi|kotko\b|ihale|yapım|yapim|inşaat|insaat|bağlantı\s+yolu|baglanti\s+yolu|kavşak\s+projesi|kavsak\s+projesi|yol\s+yapım|"
         r"yol\s+yapim|merkezi.{0,25}bitir|(?:yıl|yil)\s+içinde\s+bitir|güzergah|guzergah",),
        ((T, -220),), (r"kaza(?!n)|çarptı|carpti|yaralı|yarali|can\s+kayb|öldü|oldu",),
    ),
    Rule("R19 storm", (r"ağaç.{0,20}devril|agac.{0,20}devril|fırtına|firtina|rüzgar|ruzgar",), ((T, -150),), ("kaza|çarptı|carpti|araç|arac",)),
    Rule("R20 road stands still", (r"(?:yol|otoyol|liman\s+yolu|bağlantı|baglanti).{0,35}durdu",), ((T, -200),), ("kaza|çarp|devril|ölü|olu|yaralı|yarali|çarpış|carpis",)),
    Rule("R21 smell", (r"kötü\s+koku|kotu\s+koku|koku\s+ihbar",), ((Y, -320),), (FIRE,)),
    Rule(
        "R22 lorry on the road", (r"(kamyon|tır|tir).{0,40}(otomobil|araca?\s+saplandı|araca?\s+saplandi|yola\s+düştü|yola\s+dustu|düştü|dustu|devrildi)",), ((S, -150), (T, 15)),
        ("cinayet|saldırı|saldiri|bıçak|bicak|silah",),
    ),
    Rule("R23 sport", (SPORT,), tuple((c, -200) for c in ALL), (r"(?<![a-zçğıöşü])kaza(?!n)|yangın|yangin|kesinti|hırsız|hirsiz|cinayet|saldırı|saldiri",)),
    Rule(
        "R24 tenders", (r"ihale|yapım|yapim|inşaat|insaat|yıkılacak|yikilacak|teklif\s+sundu|yeni\s+adres|taşınacak|tasinacak",), ((K, -200),),
        (r"konser|festival|sergi|tiyatro|etkinlik\s+düzenlendi|sahne|gösteri|gosteri",),
    ),
    Rule("R25 funerals", (r"cenaze|defin|mevlit|mevlid|son\s+yolculuğ|son\s+yolculug|toprağa\s+veril|topraga\s+veril",), ((K, -200),)),
    Rule("R26 politics", (POLITICS,), ((K, -450), (T, -320), (Y, -320), (E, -320), (H, -260), (S, -140))),
    Rule(
        "R27 weather",
        (r"meteoroloji|hava\s+durumu|sağanak|saganak|yağış|yagis|kar\s+yağışı|kar\s+yagisi|sıcaklık|sicaklik|derece|fırtına\s+uyarı|firtina\s+uyari|karabasan|gün\s+gün\s+açıkladı|gun\s+gun\s+acikladi",),
        tuple((c, -150) for c in ALL), (r"kaza|yangın|yangin|sel\s+felaketi|can\s+kayb",),
    ),
    Rule(
        "R27 weather without a show",
        (r"meteoroloji|hava\s+durumu|sağanak|saganak|yağış|yagis|kar\s+yağışı|kar\s+yagisi|sıcaklık|sicaklik|derece|fırtına\s+uyarı|firtina\s+uyari|karabasan|gün\s+gün\s+açıkladı|gun\s+gun\s+acikladi",),
        ((K, -260),), (r"kaza|yangın|yangin|sel\s+felaketi|can\s+kayb", SHOW),
    ),
    Rule("R28 drinking water", (r"içme\s+suyu|icme\s+suyu|su\s+projesi|su\s+projeler|su\s+şebekesi|su\s+sebekesi",), ((Y, -220), (K, -220))),
    Rule(
        "R29 openings",
        (r"cumhurbaşkan.{0,55}(?:açılış|acilis|açılışını|acilisini|yaptı|yapti)|cumhurbaskan.{0,55}(?:açılış|acilis|açılışını|acilisini|yaptı|yapti)|"
         r"(?:proje|tesis|fabrika|santral).{0,35}(?:açılış|acilis|açılışını|acilisini)",),
        ((K, -200), (Y, -280)), ("konser|festival|sergi|tiyatro|müze|muze",),
    ),
    Rule("R30 cinema", (r"sinema|film\s+vizyona|vizyona\s+gir|film\s+gösterim|film\s+gosterim|(?:\d+)\s+yeni\s+film",), ((H, -480),)),
    Rule("R31 operation without theft", ("operasyon",), ((H, -120),), (THEFT_SNATCH,)),
    Rule("R32 operation with arrests", ("operasyon", r"gözaltı|gozalti|tutuklandı|tutuklandi|dijital\s+suç|dijital\s+suc|siber\s+operasyon|silah.{0,15}operasyon"), ((S, 24),)),
    Rule("R32 operation with arrests, no theft", ("operasyon", r"gözaltı|gozalti|tutuklandı|tutuklandi|dijital\s+suç|dijital\s+suc|siber\s+operasyon|silah.{0,15}operasyon"), ((H, -450),), (THEFT_WHOLE,)),
    Rule("R33 managers released", (r"tahliye\s+edildi|tahliye\s+oldu", r"holding|yönetim\s+kurulu|yonetim\s+kurulu"), ((H, -400),), (r"hırsız|hirsiz|soygun|çalındı|calindi|hırsızlık|hirsizlik",)),
    Rule("R34 threats", (r"tehdit\s+iddiası|tehdit\s+iddiasi",), ((K, -320), (S, 38))),
    Rule("R35 film lists", (r"sinema\s+salonlarında|sinema\s+salonlarinda", r"yeni\s+film|vizyona"), ((K, -420),)),
    Rule("R36 health", (r"erken\s+teşhis|erken\s+teshis|kanserden\s+kurtul|kanser\b|ameliyat|tedavi\s+gördü|tedavi\s+gordu",), ((S, -240), (K, -220)), (CRIME,)),
    Rule(
        "R37 schools", (r"okul\s+müdür|okul\s+mudur|müdürü\s+ve\s+öğretmen|muduru\s+ve\s+ogretmen|görevden\s+uzaklaştır|gorevden\s+uzaklastir|veli.{0,20}şikayet|veli.{0,20}sikayet",),
        ((K, -300),),
    ),
    Rule("R38 good news", (r"müjde\b|mujde\b", "rahatsız|rahatsiz"), ((H, -450),)),
    Rule("R39 supplier's pit", (SUPPLIER, r"çukur|cukur|kazı|kazi|kazdı|kazdi|belediye\s+aracı|belediye\s+araci|düştü|dustu|devril"), ((E, -520),)),
    Rule("R40 bridge works", ("köprü|kopru", "bakım|bakim|onarım|onarim|çalışması|calismasi", "trafik|felç|felc|yoğunluk|yogunluk"), ((E, -480),)),
    Rule("R41 pharmacies", (r"nöbetçi\s+eczane|nobetci\s+eczane|nöbetçi\s+eczaneler|nobetci\s+eczaneler",), ((K, -520),)),
    Rule("R42 values", (r"manevi\s+değer|manevi\s+deger",), ((K, -450),)),
    Rule("R43 civil defence", (r"kbrn|sivil\s+savunma|afet.{0,100}farkındalık|afet.{0,100}farkindalik|afet.{0,100}farkındalığı|afet.{0,100}farkindaligi",), ((Y, -720),)),
    Rule(
        "R43 civil defence taught",
        (r"kbrn|sivil\s+savunma|afet.{0,100}farkındalık|afet.{0,100}farkindalik|afet.{0,100}farkındalığı|afet.{0,100}farkindaligi",
         "farkındalık|farkindalik|eğitim|egitim|personeline|personel|tatbikat|artırıldı|artirildi|korunma|hazırlık|hazirlik"),
        ((K, 62),), group="civil defence",
    ),
    Rule("R43 civil defence else", (r"kbrn|sivil\s+savunma|afet.{0,100}farkındalık|afet.{0,100}farkindalik|afet.{0,100}farkındalığı|afet.{0,100}farkindaligi",), ((K, -100),), group="civil defence"),
    Rule(
        "R44 planting by the refinery", (r"(?:100\s+bin\s+fidan|tüpraş|tupras).{0,50}(?:fidan|ağaçlandır|agaclandir)|(?:fidan|ağaçlandır|agaclandir).{0,40}(?:tüpraş|tupras|100\s+bin)",),
        ((Y, -520),), group="planting",
    ),
    Rule("R44 planting", (r"fidan|ağaçlandır|agaclandir|orman\s+sağlığı|orman\s+sagligi|100\s+bin\s+fidan",), ((Y, -520),), (FIRE,), group="planting"),
    Rule("R45 refinery's trees", ("tüpraş|tupras", r"fidan|ağaçlandır|agaclandir|100\s+bin"), ((E, -620), (K, 52))),
    Rule("R46 car in the pit", (SUPPLIER, "çukur|cukur|kazı|kazi|kazdı|kazdi", "arac|araç|düştü|dustu|devril"), ((H, -500), (T, 55))),
    Rule("R47 stove", (r"soba\s+facias",), ((Y, -420),), (r"yangın|yangin|alev|itfaiye|yanan\s|duman",)),
    Rule("R48 motorway accident", (r"(?:tem\b|tem\s+otoyolu|otoyol).{0,120}(?:feci\s+)?kaza|(?:feci\s+)?kaza.{0,80}(?:tem\b|tem\s+otoyolu|otoyol)",), ((Y, -780), (T, 60))),
    Rule("R49 motorway pile-up", (r"(?:tem\b|otoyol).{0,80}zincirleme|zincirleme.{0,40}(?:tem\b|otoyol)",), ((Y, -520), (T, 35))),
    Rule("R50 car tax", ("ötv|otv", "otomobil|araç|arac|meclis|düzenleme|duzenleme|onaylandı|onaylandi"), ((T, -380),)),
    Rule("R51 the bar", ("baro", r"yeni\s+avukat|avukatlar?\s+(?:katıldı|katildi|kaydoldu)|staj\s+sürecini|staj\s+surecini|yemin\s+etti"), ((K, -450),)),
    Rule("R52 courts", (r"adliye|başsavcılık|bassavcilik|cumhuriyet\s+başsavcılığı|dosyalarda.{0,20}rekor|yargı\s+tarih",), ((K, -480),)),
    Rule("R53 fraud", (r"dolandırıcılık\s+iddiası|dolandiricilik\s+iddiasi|dolandırıcılık\s+iddia",), ((K, -450), (S, 28))),
    Rule("R54 hospitals", ("hastan", r"deprem\s+farkındalık|deprem\s+farkindalik|112\s+günü|112\s+gunu"), ((K, -400),)),
    Rule("R55 farming", ("gıda|gida|tarım|tarim|hayvancılık|hayvancilik", r"masaya\s+yatırıldı|masaya\s+yatirildi|toplantı|toplanti|çalıştay|calistay"), ((K, 78), (T, -560), (S, -420))),
    Rule(
        "R56 accident in sport", (r"turnuva|spor\s+salon|sahada|maçta|macta", r"talihsiz\s+kaza|\bkaza\b"), ((T, -520),),
        (r"tem\b|otoyol|karayolu|trafik|otomobil|kamyon|minibüs|minibus|sürücü|surucu|yayaya\s+çarptı|yayaya\s+carpti|emniyet\s+şeridi|emniyet\s+seridi",),
    ),
    Rule("R57 pupils' show", (r"liseli|meslek\s+lisesi|meslek\s+okul", "şef|sef|sergiledi|yetenek"), ((K, -320),)),
    Rule("R58 struggle for life", (r"yaşam\s+mücadelesi|yasam\s+mucadelesi",), ((T, -380),), (r"kaza|çarp|trafik|otoyol|tem\b|araç|arac|sürücü|surucu",)),
    Rule("R59 pilgrims defrauded", ("dolandırıldı|dolandirildi|dolandırıldığını", r"umre|karakol|şikayet|şikayeti|200\s+kişi"), ((H, -450), (S, 32))),
    Rule("R60 murder and fraud", (r"öldüren|olduren|cinayet|baba\s+ve\s+oğlu|baba\s+ve\s+oglu", "dolandır|keşke|keske"), ((H, -500), (S, 40))),
    Rule("R61 doctors' report", (r"hekimsen|tabipler\s+birliği|tabipler\s+birligi|doktorlar\s+birliği",), ((K, -300),)),
)
