"""What operators know about a language and a region, as data. Lexicons and rules are tables that users bring."""

from __future__ import annotations

from dataclasses import dataclass, field

from newsloom.rules import CONTEXT_RULES, POWER_CUT, POWER_MADE, WATER_CUT, Rule


@dataclass(frozen=True)
class Profile:
    categories: tuple[str, ...]
    display: dict[str, str] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    context: tuple[Rule, ...] = ()  # rules of what else a text says, beside ``rules``
    letters: str = "a-zçğıöşü"
    longest_suffix: int = 8
    title_factor: int = 2
    threshold: int = 8
    never: dict[str, str] = field(default_factory=dict)  # keyword -> beginning of tokens that do not count for it
    districts: tuple[tuple[str, tuple[str, ...]], ...] = ()  # in order of preference
    url_hints: tuple[tuple[str, str], ...] = ()
    foreign: tuple[str, ...] = ()
    local_hints: tuple[str, ...] = ()
    province: str = ""
    suffixes: str = r"(?:'(?:te|ta|de|da|ten|tan|nin|nın|nün|nun)|te|de|da|ten|tan)\b"
    country: str = ""
    center: tuple[float, float] = (0.0, 0.0)
    center_label: str = ""
    default_addresses: tuple[str, ...] = ()  # tried last
    district_names: tuple[str, ...] = ()


#: Fixed values of the Turkish profile.
TURKISH = Profile(
    categories=("Trafik Kazasi", "Yangin", "Elektrik Kesintisi", "Suc ve Cinayet", "Hirsizlik", "Kulturel Etkinlikler"),  # of equal scores the first wins
    display={"Trafik Kazasi": "Trafik Kazası", "Yangin": "Yangın", "Hirsizlik": "Hırsızlık", "Suc ve Cinayet": "Suç ve Cinayet", "Kulturel Etkinlikler": "Kültürel Etkinlikler"},
    never={"kesinti": "kesintisiz"},
    districts=(
        ("Izmit", ("izmit",)), ("Gebze", ("gebze",)), ("Darica", ("darıca", "darica")), ("Cayirova", ("çayırova", "cayirova")), ("Dilovasi", ("dilovası", "dilovasi")),
        ("Golcuk", ("gölcük", "golcuk")), ("Karamursel", ("karamürsel", "karamursel")), ("Kandira", ("kandıra", "kandira")), ("Kartepe", ("kartepe",)),
        ("Basiskele", ("başiskele", "basiskele")), ("Derince", ("derince",)), ("Korfez", ("körfez", "korfez")),
    ),
    url_hints=(
        ("gebze", "Gebze"), ("darica", "Darica"), ("darıca", "Darica"), ("golcuk", "Golcuk"), ("gölcük", "Golcuk"), ("korfez", "Korfez"), ("körfez", "Korfez"),
        ("derince", "Derince"), ("kartepe", "Kartepe"), ("kandira", "Kandira"), ("kandıra", "Kandira"), ("karamursel", "Karamursel"), ("karamürsel", "Karamursel"),
        ("basiskele", "Basiskele"), ("başiskele", "Basiskele"), ("cayirova", "Cayirova"), ("çayırova", "Cayirova"), ("dilovasi", "Dilovasi"), ("dilovası", "Dilovasi"), ("izmit", "Izmit"),
    ),
    foreign=(
        "istanbul", "ankara", "izmir", "rize", "antalya", "bursa", "adana", "konya", "gaziantep", "mersin", "niğde", "nigde", "muğla", "mugla", "van", "diyarbakır", "diyarbakir",
        "şanlıurfa", "sanliurfa", "eskişehir", "eskisehir", "trabzon", "samsun", "malatya", "kahramanmaraş", "kahramanmaras", "tekirdağ", "tekirdag", "balıkesir", "balikesir",
        "aydın", "aydin", "denizli", "kayseri", "sakarya", "ordu", "polatlı", "polatli", "düzce", "duzce", "bolu", "yalova", "çanakkale", "canakkale", "edirne", "kırklareli",
        "kirklareli", "hatay", "tokat", "sivas", "erzurum", "elazığ", "elazig", "okmeydanı", "okmeydani", "gayrettepe", "beşiktaş", "besiktas", "kadıköy", "kadikoy", "üsküdar",
        "uskudar", "beyoğlu", "beyoglu", "şişli", "sisli", "bakırköy", "bakirkoy", "fatih",
    ),
    local_hints=(
        "ilimizde", "ilimiz", "kocaelide", "kocaeli'de", "kocaelideki", "buyuksehir", "büyükşehir", "belediyesi", "belediye başkanı", "belediye baskani", "kbb", "kentte",
        "şehrimizde", "sehrimizde", "körfezde", "korfezde",
    ),
    province="Kocaeli",
    country="Türkiye",
    center=(40.7654, 29.9408),
    center_label="Kocaeli (genel konum)",
    context=CONTEXT_RULES,
    default_addresses=("İzmit, Kocaeli, Türkiye", "Izmit, Kocaeli, Turkey", "Kocaeli, Türkiye"),
    # Patterns and deltas.
    rules=(
        Rule(
            "words of accidents",
            (r"trafik.{0,80}kaza(?!n[a-zçğıöşü])|kaza(?!n[a-zçğıöşü]).{0,80}trafik|(?<![a-zçğıöşü])yol.{0,50}kaza(?!n[a-zçğıöşü])|otoyol.{0,50}kaza(?!n[a-zçğıöşü])|d100|d-100|"
             r"araçlar.{0,30}çarpış|araclar.{0,30}carpis|çarpıştı|carpisti|yaralamalı\s+kaza|yaralamali\s+kaza",),
            (("Trafik Kazasi", 14),),
        ),
        Rule(
            "words of fires",
            (r"yangın.{0,20}çıktı|yangin.{0,20}cikti|alev.{0,15}aldi|yanan\s+(?:ev|işyeri|araç|arac)|itfaiye.{0,25}müdahale|itfaiye.{0,25}mudahale|yangına.{0,15}müdahale|yangina.{0,15}mudahale",),
            (("Yangin", 11),),
        ),
        Rule(
            "words of power cuts",
            (r"elektrik.{0,40}kesinti|kesinti.{0,30}elektrik|trafo.{0,20}arıza|trafo.{0,20}ariza|abone.{0,25}kesinti|mahalle.{0,40}kesinti|kesinti.{0,20}program|kesinti.{0,20}saat|elektrik.{0,25}ne\s+zaman",),
            (("Elektrik Kesintisi", 14),), ("kesintisiz", WATER_CUT), unless=((POWER_MADE, POWER_CUT),),
        ),
        Rule(
            "words of theft",
            (r"hırsız|hirsiz|soygun|çalındı|calindi|kapkaç|kapkac|silahlı\s+soygun|silahli\s+soygun|evden\s+hırsız|evden\s+hirsiz",),
            (("Hirsizlik", 9),), (r"katliam|cinayet|narkotik|uyuşturucu|uyusturucu|sahte\s+hesap|kesici\s+alet",),
        ),
        Rule(
            "words of crime",
            (r"katliam|cinayet|narkotik.{0,45}ekip|narkotik\s+operasyon|uyuşturucu\s+operasyon|uyusturucu\s+operasyon|sahte\s+hesap.{0,25}operasyon|"
             r"bilgilendirme\s+seferberliği.{0,40}narkotik|narkotik.{0,30}bilgilendirme|kesici\s+aletle\s+cinayet|bar\s+katliam|kanlı\s+gece.{0,30}cinayet|"
             r"gözaltı.{0,15}katliam|gozaltı.{0,15}katliam|kanlı\s+gece|kanli\s+gece|kanlı\s+saldırı|kanli\s+saldiri|(?:\d+)\s+(?:ölü|olu|öldü|oldu).{0,30}(?:\d+)\s+yaralı",),
            (("Suc ve Cinayet", 14),),
        ),
        Rule(
            "words of culture",
            (r"konser|festival|sergi|tiyatro|fuar|yarışma|yarismasi|kermes|tören|toren|kültür\s+merkezi|kultur\s+merkezi|müze|muze|sanat.{0,15}günü|sanat.{0,15}gunu|"
             r"gösteri|gosteri|atölye|atolye|dinleti|şölen|solen",),
            (("Kulturel Etkinlikler", 4),),
        ),
        Rule(
            "words of events",
            (r"etkinlik\s+düzenlendi|etkinlik\s+duzenlendi|etkinlik.{0,15}(?:açık|acik|ücretsiz|ucretsiz|davet|katılım|katilim)",), (("Kulturel Etkinlikler", 5),),
        ),
        Rule("title of power made", (POWER_MADE,), must_not=(POWER_CUT,), field="title", reset=("Elektrik Kesintisi",)),
        Rule("url traffic", (r"trafik|(?<![a-zçğıöşü])kaza(?![a-zçğıöşü])",), (("Trafik Kazasi", 12),), field="url"),
        Rule(
            "url power cut",
            ("sedas|sedaş|gedas|gedaş|trafo-ariza|trafo-arıza|elektrik-kesintisi|elektrik-kesinti|enerji-kesintisi|kesinti-program|planli-kesinti|programli-kesinti|elektrik.{0,25}kesinti|kesinti.{0,20}elektrik",),
            (("Elektrik Kesintisi", 14),), ("kesintisiz",), field="url", group="url power cut", unless=((POWER_MADE, POWER_CUT),),
        ),
        Rule(
            "url cut", (r"(?<![a-zçğıöşü])kesinti(?!siz)[a-zçğıöşü]{0,8}(?![a-zçğıöşü])",), (("Elektrik Kesintisi", 8),), ("kesintisiz",), field="url", group="url power cut",
            unless=((POWER_MADE, POWER_CUT),),
        ),
        Rule("url fire", ("yangin|yangın|itfaiye",), (("Yangin", 12),), field="url"),
        Rule("url public order", ("asayis|asayiş|3-sayfa|3sayfa|guvenlik|güvenlik|emniyet",), (("Trafik Kazasi", 7), ("Suc ve Cinayet", 8), ("Hirsizlik", 5)), field="url"),
        Rule("url culture, narrow", ("kultur-sanat|konser|festival|sergi|tiyatro|fuar",), (("Kulturel Etkinlikler", 12),), field="url"),
        Rule("url culture, wide", ("kultur|kültür|sanat|etkinlik|muzik|müzik",), (("Kulturel Etkinlikler", 5),), field="url"),
    ),
)
