"""The language of a text by character profiles: log-probabilities of each letter after the two before it, fitted from a written sample for thirty languages.

Counts of three letters fall back to those of two, of one, and to the share that the letter's script has in the sample. A profile is a few thousand
counts, made once in each Python worker; texts are scored as arrays of code points, whole, in Arrow batches."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.arrow import by_row

#: The written sample: sentences on rights, rivers and results, then frequent words.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. The results show that the water of the river was higher in spring than in the other months of the year, which had not been measured before. We thank all those who have helped us with this work. the of and to in is that it for was with as by on be are this not or from",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Die Ergebnisse zeigen, dass das Wasser des Flusses im Frühling höher stand als in den anderen Monaten des Jahres, was vorher nicht gemessen worden war. Wir danken allen, die uns bei dieser Arbeit geholfen haben. der die das und in den von zu mit sich des auf für ist im nicht ein eine als auch",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Les résultats montrent que l'eau de la rivière était plus haute au printemps que pendant les autres mois de l'année, ce qui n'avait jamais été mesuré. Nous remercions tous ceux qui nous ont aidés dans ce travail. le la les de des et en un une du que qui dans pour sur pas est au par plus",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Los resultados muestran que el agua del río era más alta en primavera que en los otros meses del año, lo que no se había medido antes. Damos las gracias a todos los que nos han ayudado en este trabajo. el la los las de que y en un una del se por con para no es al lo como",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. I risultati mostrano che l'acqua del fiume era più alta in primavera che negli altri mesi dell'anno, cosa che non era mai stata misurata. Ringraziamo tutti quelli che ci hanno aiutato in questo lavoro. il la di che e una per in del della con non si da le dei sono al come",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo indivíduo tem direito à vida, à liberdade e à segurança pessoal. Os resultados mostram que a água do rio estava mais alta na primavera do que nos outros meses do ano, o que não tinha sido medido antes. Agradecemos a todos os que nos ajudaram neste trabalho. o a os as de que e em um uma do da para com não por se na no mais",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. De resultaten laten zien dat het water van de rivier in het voorjaar hoger stond dan in de andere maanden van het jaar, wat niet eerder gemeten was. Wij danken allen die ons bij dit werk hebben geholpen. de het van een en in is dat op te zijn met voor niet aan er door ook als bij",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má právo na život, svobodu a osobní bezpečnost. Výsledky ukazují, že voda v řece byla na jaře vyšší než v ostatních měsících roku, což dříve nebylo měřeno. Děkujeme všem, kteří nám při této práci pomohli. a v se na je že s z do o k i ale jako jsou pro by po podle který být jeho také nebo",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. Enhver har ret til liv, frihed og personlig sikkerhed. Resultaterne viser, at vandet i floden stod højere om foråret end i årets andre måneder, hvilket ikke var blevet målt før. Vi takker alle dem, der har hjulpet os med dette arbejde. og i at det er en til af på for som med den de ikke der et var fra han ved blev også",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokaisella yksilöllä on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen. Tulokset osoittavat, että joen vesi oli keväällä korkeammalla kuin vuoden muina kuukausina, mitä ei ollut aiemmin mitattu. Kiitämme kaikkia, jotka ovat auttaneet meitä tässä työssä. ja on ei se että oli ovat mutta tai kun myös kuin ole joka hän sen sekä niin tämä",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Minden személynek joga van az élethez, a szabadsághoz és a személyi biztonsághoz. Az eredmények azt mutatják, hogy a folyó vize tavasszal magasabb volt, mint az év többi hónapjában, amit korábban nem mértek. Köszönjük mindazoknak, akik segítettek nekünk ebben a munkában. a az és hogy nem is egy ez volt meg van de ha csak már mint azt vagy még el",
    "id": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. Setiap orang berhak atas penghidupan, kebebasan dan keselamatan individu. Hasil penelitian menunjukkan bahwa air sungai lebih tinggi pada musim semi daripada bulan-bulan lain dalam tahun itu, yang belum pernah diukur sebelumnya. Kami berterima kasih kepada semua yang telah membantu kami. yang dan di ini itu dengan untuk dari pada tidak dalam adalah akan oleh ke juga dapat sebagai telah atau",
    "nb": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. Enhver har rett til liv, frihet og personlig sikkerhet. Resultatene viser at vannet i elven sto høyere om våren enn i de andre månedene i året, noe som ikke hadde blitt målt før. Vi takker alle dem som har hjulpet oss med dette arbeidet. og i det er på som en til av for at med de ikke den har et fra ble var om også",
    "nn": "Alle menneske er fødde til fridom og med same menneskeverd og menneskerettar. Dei har fått fornuft og samvit og skal leve med kvarandre som brør. Alle har rett til liv, fridom og personleg tryggleik. Resultata viser at vatnet i elva stod høgare om våren enn i dei andre månadene i året, noko som ikkje hadde vorte målt før. Vi takkar alle dei som har hjelpt oss med dette arbeidet. og i det er på som ein til av for at med dei ikkje den har eit frå vart var om også",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby. Wyniki pokazują, że woda w rzece była wiosną wyższa niż w innych miesiącach roku, czego wcześniej nie mierzono. Dziękujemy wszystkim, którzy pomogli nam w tej pracy. i w na z do się że jest nie to o jak po od przez dla są oraz który był",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Orice ființă umană are dreptul la viață, la libertate și la securitatea persoanei sale. Rezultatele arată că apa râului era mai înaltă primăvara decât în celelalte luni ale anului, ceea ce nu fusese măsurat înainte. Mulțumim tuturor celor care ne-au ajutat la această lucrare. și în de la cu pe care nu o un din este a că mai pentru sunt sau al ale",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. Var och en har rätt till liv, frihet och personlig säkerhet. Resultaten visar att vattnet i floden stod högre på våren än under årets andra månader, vilket inte hade mätts tidigare. Vi tackar alla dem som har hjälpt oss med detta arbete. och i att det som en på är av för med till den har inte om ett de var från vid",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır. Sonuçlar, nehrin suyunun ilkbaharda yılın diğer aylarına göre daha yüksek olduğunu gösteriyor; bu daha önce ölçülmemişti. Bu çalışmada bize yardım eden herkese teşekkür ederiz. ve bir bu da de için ile olarak çok daha olan gibi en ne o kadar sonra var ancak ya",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Mọi người đều có quyền sống, quyền tự do và an toàn cá nhân. Kết quả cho thấy nước sông vào mùa xuân cao hơn các tháng khác trong năm, điều chưa từng được đo trước đây. Chúng tôi cảm ơn tất cả những người đã giúp đỡ. và của là có trong được cho một các không với những người này đã để từ khi đến về",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Результаты показывают, что вода в реке весной была выше, чем в другие месяцы года, чего раньше не измеряли. Мы благодарим всех, кто помог нам в этой работе. и в не на что с по это как из к но от его для она то так был же",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Кожна людина має право на життя, на свободу і на особисту недоторканність. Результати показують, що вода в річці навесні була вищою, ніж в інші місяці року, чого раніше не вимірювали. Ми дякуємо всім, хто допоміг нам у цій роботі. і в не на що з та це як до але від його для вона у є був",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "bn": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিত।",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权享有生命、自由和人身安全。结果表明，春季的河水高于一年中的其他月份，这在以前没有测量过。",
}
LANGUAGES = tuple(SAMPLES)
#: How many unseen occurrences the shorter history counts for, at each step of falling back.
PRIOR = 5.0
#: The lead in probability that the best language needs over the next.
LEAD = 0.10
#: Scripts by ranges of code points, each with about the number of its letters; anything else is one more.
SCRIPTS = [("latin", 0x41, 0x24F, 60), ("latin", 0x1E00, 0x1EFF, 60), ("greek", 0x370, 0x3FF, 40), ("cyrillic", 0x400, 0x52F, 40), ("hebrew", 0x590, 0x5FF, 30), ("arabic", 0x600, 0x77F, 45), ("devanagari", 0x900, 0x97F, 70), ("bengali", 0x980, 0x9FF, 60), ("thai", 0xE00, 0xE7F, 70), ("kana", 0x3040, 0x30FF, 150), ("han", 0x3400, 0x9FFF, 4000), ("hangul", 0xAC00, 0xD7AF, 2000)]
SHARED = ("latin", "cyrillic")
#: What parts words: anything but letters, and the vowel signs and accents of scripts that write them apart.
_BREAK = re.compile(r"(?:[^\w\u0591-\u05C7\u064B-\u0652\u0900-\u09FF\u0E00-\u0E7F]|[\d_])+")
#: Trigrams whose probabilities a worker remembers.
REMEMBERED = 200_000


def letters(text: str) -> str:
    """Lower-case words between single blanks, two before the first."""
    return f"  {_BREAK.sub(' ', text.lower()).strip()} "


@lru_cache
def _breaks() -> np.ndarray:
    """For each code point whether it parts words."""
    out = np.zeros(0x110000, bool)
    for m in _BREAK.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def points_of(text: str) -> np.ndarray:
    """The code points of letters()."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    gap = _breaks()[points]
    kept = ~gap
    kept[1:] |= ~gap[:-1]  # the first of a run of breaks stands for it
    points = np.where(gap, 32, points)[kept].astype(np.int64)
    return np.concatenate([[32, 32], points[int(len(points) > 0 and points[0] == 32) : len(points) - int(len(points) > 1 and points[-1] == 32)], [32]])


@lru_cache
def _scripts() -> tuple[np.ndarray, list[tuple[str, int]]]:
    """For each code point the number of its script(), and the scripts; a blank has none."""
    kinds = list(dict.fromkeys([*((name, n) for name, _, _, n in SCRIPTS), ("other", 1000)]))
    out = np.full(0x110000, kinds.index(("other", 1000)), np.uint8)
    for name, low, high, n in reversed(SCRIPTS):  # the first range that holds a letter counts
        out[low : high + 1] = kinds.index((name, n))
    out[32] = len(kinds)
    return out, kinds


def script(c: str) -> tuple[str, int]:
    return next(((name, n) for name, low, high, n in SCRIPTS if low <= ord(c) <= high), ("other", 1000))


class Profiles:
    """Counts of the sample, and log-probabilities of a letter after two for all languages at once."""

    def __init__(self, samples: dict[str, str] = SAMPLES):
        self.counts = []
        for sample in samples.values():
            s = letters(sample)
            grams = [Counter(s[i - n + 1 : i + 1] for i in range(2, len(s))) for n in (1, 2, 3)]
            before = [Counter(), Counter(), Counter()]
            for n in (2, 3):
                for g, k in grams[n - 1].items():
                    before[n - 1][g[:-1]] += k
            scripts = Counter()
            for c, k in grams[0].items():
                scripts["blank" if c == " " else script(c)[0]] += k
            self.counts.append((grams, before, scripts, sum(grams[0].values())))
        self.known, self.rows = np.empty(0, np.int64), np.empty((0, len(self.counts)))

    def logs(self, gram: str) -> np.ndarray:
        """Of the last letter of three, for each language."""
        c = gram[2]
        name, size = ("blank", 1) if c == " " else script(c)
        out = np.empty(len(self.counts))
        for i, (grams, before, scripts, total) in enumerate(self.counts):
            p = (scripts[name] + 0.01) / (total + 0.1) / size
            p = (grams[0][c] + PRIOR * p) / (total + PRIOR)
            p = (grams[1][gram[1:]] + PRIOR * p) / (before[1][gram[1]] + PRIOR)
            out[i] = math.log((grams[2][gram] + PRIOR * p) / (before[2][gram[:2]] + PRIOR))
        return out

    def scores(self, points: np.ndarray) -> np.ndarray:
        """The log-probability of a whole text, as points_of() has it, in each language."""
        if len(points) < 4:
            return np.zeros(len(self.counts))
        keys, n = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
        at = np.searchsorted(self.known, keys)
        new = keys[self.known.take(at, mode="clip") != keys] if len(self.known) else keys
        if len(new):
            if len(self.known) > REMEMBERED:
                self.known, self.rows, new = self.known[:0], self.rows[:0], keys
            rows = np.array([self.logs(chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF)) for k in new.tolist()])
            place = np.searchsorted(self.known, new)
            self.known, self.rows = np.insert(self.known, place, new), np.insert(self.rows, place, rows, axis=0)
            at = np.searchsorted(self.known, keys)
        return n @ self.rows[at]


@lru_cache
def profiles() -> Profiles:
    return Profiles()


def best(text: str | None) -> str | None:
    """The likeliest language of a text; null without letters, where its lead in probability over the next is under LEAD, and where, in a script of several languages, letters
    drawn at random would be likelier."""
    if not text:
        return None
    points = points_of(text)
    s = profiles().scores(points)
    of, kinds = _scripts()
    own = of[points]
    n = np.bincount(own, minlength=len(kinds) + 1)[: len(kinds)]
    found = {kinds[i]: int(n[i]) for i in sorted(np.flatnonzero(n).tolist(), key=lambda i: np.argmax(own == i))}  # in the order of their first letters
    if not found or max(found, key=found.get)[0] in SHARED and s.max() <= -sum(k * math.log(n) for (_, n), k in found.items()):
        return None
    p = np.exp(s - s.max())
    p /= p.sum()
    first, second = np.argsort(-p, kind="stable")[:2]
    return LANGUAGES[first] if p[first] - p[second] >= LEAD else None


by_profile = by_row(T.StringType())(best)


def gate(c: Column) -> Column:
    """Texts long enough to tell a language: 200 characters, or 50 beyond ASCII."""
    return (F.length(c) >= 200) | (F.length(F.regexp_replace(c, r"[\x00-\x7F]", "")) >= 50)


def language(c: Column) -> Column:
    """Code of a text's language, if the gate is passed and one language leads clearly; else null, as for a null."""
    return by_profile(F.when(gate(c), c))
