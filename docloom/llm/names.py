"""Problem 1: variant spellings of the names of persons, organisations and products.

1. Every name is parsed once: titles off, abbreviations and nicknames written out, scripts,
   accents and traditional characters folded, numbers and generation kept apart.
2. Blocks are phonetic codes of the sorted tokens (for Chinese their syllables), inside one
   knowledge base and with equal numbers; a code is entered whole and with one sound left
   out, so that a slip in it doesn't part a pair. Equal parsed names are one form and are
   compared once.
3. Pairs of a block are compared token by token with Jaro-Winkler, initials and abbreviations
   counting as their words. Descriptions that state facts (place, year, post) must not disagree.
4. Accepted pairs are clustered by connected components. A form that fits too much by itself
   (a title and a surname, say) joins a cluster only if no other one fits it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import Stage

from . import groups

# fixed values: given names and their nicknames
_NICKNAMES = """
alexander alex alec sandy xander sasha; andrew andy drew; anthony tony; benjamin ben benny; charles charlie chuck chas; christopher chris kit topher; deborah deb debbie debby; dolores lola dolly;
dorothy dot dottie; edward ed eddie ted teddy ned; ekaterina katya kate katia; elizabeth liz beth lizzie betty eliza betsy libby; francisco frank paco pancho francis; frederick fred freddie freddy;
gabriele gabi gaby; gregory greg; harold harry hal; helga hella; henry hank; ingrid inga; james jim jimmy jamie; jennifer jen jenny; johannes hans hannes; john jack johnny; jonathan jon jonny nathan;
joseph joe joey jo; katherine kathy katie kat cathy kate kay; leonard leo len lenny; lucia lucy luci; margaret maggie meg peggy marge; marlene marla; matthew matt; michael mike mick mickey mikey;
nicholas nick nicky nico; patricia pat patty trish tricia patsy; peter pete; rebecca becky becca; richard rick dick rich richie ricky; robert rob bob bobby robbie; samuel sam sammy; stephen steve;
susan sue susie suzy; theodore theo teddy ted; thomas tom tommy; timothy tim timmy; victoria vicky vicki tori; wilhelmina mina willa minna billie; william will bill billy willy liam; dmitri dima mitya;
nadia nadya; erwin irwin; oskar oscar
"""
# fixed values: words written short in names of organisations and products
_ABBREVIATIONS = """
laboratory lab labs laboratories; university univ uni; institute inst instit; association assn assoc ass; department dept dep; bureau bur; agency agcy agy; corporation corp; foundation fdn found fndn fnd;
company co cie; limited ltd; research res; engineering eng engg; services svcs serv svc; science sci; center centre ctr; office off; committee cttee; society soc; academy acad; hospital hosp; college coll
"""
_TYPES = set("laboratory university institute association department bureau agency corporation foundation company center office committee society academy hospital college".split())
_SMALL = set("the of for and a an".split())
_TITLES = set("dr prof professor eng engineer mr mrs ms mx miss sir dame director president chief dipl ing herr frau rev hon capt".split())
_GENERATION = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "2", "iii": "3", "iv": "4"}
_HONORIFICS = "博士 女士 先生 教授 主任 老师 小姐 经理 工程师 院士 局长 所长 校长 处长 科长 同志 夫人 太太 师傅 总监 主管".split()
_HAN_TYPES = "有限责任公司 有限公司 公司 研究所 研究院 实验室 管理局 基金会 委员会 协会 大学 学院 中心 学会 局 院 所 会 室 大 部 厂 处".split()
# fixed values: traditional and simplified characters
_SIMPLER = dict(
    "衛卫 蓮莲 麗丽 寧宁 銘铭 鄭郑 蘭兰 韓韩 謙谦 華华 雲云 藝艺 馬马 嶺岭 鄒邹 謝谢 孫孙 聲声 亞亚 檔档 學学 協协 會会 號号 測测 應应 軌轨 業业 糧粮 倉仓 儲储 圖图 輿舆 復复 修修 紡纺 織织 檢检 驗验 實实 鏈链 責责 級级 "
    "類类 庫库 潔洁 陳陈 劉刘 張张 楊杨 趙赵 黃黄 許许 馮冯 蔣蒋 葉叶 呂吕 魯鲁 顧顾 龍龙 萬万 錢钱 湯汤 羅罗 賈贾 鄧邓 蕭萧 閻阎 齊齐 龔龚 賢贤 韻韵 錦锦 銳锐 鳳凤 鵬鹏 儀仪 偉伟 傑杰 國国 園园 圓圆 堅坚 強强 恆恒 慶庆 曉晓 東东 "
    "棟栋 榮荣 樂乐 樹树 歡欢 漢汉 濤涛 瀾澜 滿满 潤润 爾尔 瑋玮 瑤瑶 瑩莹 禮礼 穎颖 紅红 紹绍 維维 綺绮 縣县 義义 聖圣 莊庄 藍蓝 蘇苏 詩诗 誠诚 諾诺 豐丰 軒轩 達达 運运 遠远 鐵铁 開开 陽阳 陸陆 雙双 靈灵 靜静 顏颜 飛飞 駿骏 鴻鸿 "
    "鶴鹤 鷺鹭 齡龄 區区 鎮镇 鄉乡 灣湾 嶼屿 臺台 竇窦 賽赛 資资 護护 務务 際际 質质 環环 電电 機机 術术 報报 員员 處处 廠厂 職职 專专 總总 團团 課课 飾饰 漁渔 農农 種种 濾滤 產产 經经 貿贸 橋桥 嵐岚 澤泽 淥渌 溝沟 潯浔 壩坝 崗岗 嶠峤 峽峡 島岛 廣广 楓枫 樓楼 淵渊 溫温 澗涧 濱滨 燈灯 畢毕 盧卢 礦矿 節节 範范 築筑 簡简 紀纪 純纯 紙纸 綠绿 網网 繪绘 聯联 臨临 舊旧 藥药 蘆芦 裝装 規规 視视 觀观 訂订 記记 "
    "訓训 設设 訊讯 評评 試试 語语 調调 論论 證证 議议 讀读 貨货 貴贵 費费 載载 輪轮 輸输 轉转 郵邮 醫医 針针 鋼钢 鏡镜 長长 門门 閘闸 關关 陰阴 險险 頂顶 領领 頭头 題题 風风 養养 館馆 體体 魚鱼 麥麦 點点".split()
)
# fixed values: syllable and characters read so
_SYLLABLES = """
an 安桉|ang 昂|ao 奥|bai 白|bao 包宝|bi 毕|bin 彬|bo 博柏波泊|cai 蔡|cao 曹|ce 策|cen 岑|chang 常昌|chen 陈晨辰沉|cheng 程成诚澄|chu 褚楚|cui 崔翠|da 达大|dai 岱戴|dan 丹|dao 道|deng 邓|di 荻迪|ding 丁鼎顶定|dong 董东|dou 窦|du 杜渡|
duan 段|en 恩蒽|fan 范帆凡樊繁|fang 方芳|fei 飞菲|feng 冯峰丰枫凤|fu 甫辅傅福府|gang 罡刚|gao 高|ge 葛歌戈|geng 耿|gong 龚|gu 顾古|guan 观关|guo 郭|hai 海|han 韩涵晗翰寒含|hang 航|hao 浩郝昊|he 何贺和|heng 衡恒横|hong 弘洪宏|hou 侯|
hu 胡湖|hua 华桦化|huan 焕奂|huang 黄|hui 惠慧辉汇会|ji 霁季吉济|jia 佳贾嘉家加|jian 建健剑见坚简|jiang 蒋江姜|jie 洁杰捷|jin 锦金晋瑾近津|jing 景静晶京敬靖|jun 隽俊君军|kai 恺凯|kang 康|kong 孔|lan 兰岚澜阑蓝篮|lang 琅|le 乐勒|lei 雷|li 黎李丽莉立|
lian 莲涟廉联|liang 亮良梁凉|lin 霖琳林临|ling 岭翎泠玲灵凌令|liu 柳刘|long 隆龙|lu 鹭鲁陆卢溇璐渌露|lv 吕|luo 罗洛珞络骆|ma 马|man 曼蔓|mao 毛茅|mei 梅湄玫美|meng 孟|miao 苗|min 民敏岷闽|ming 铭明茗名鸣|mu 慕穆|na 娜|nan 楠南|ni 倪|ning 宁凝|pan 潘|
pei 培佩裴|peng 彭鹏|ping 平坪萍|pu 璞浦蒲普|qi 琪戚齐|qian 谦钱千|qiao 桥峤乔|qin 秦沁琴|qing 晴清庆青|qiu 邱秋|ran 然|ren 任|rong 荣容|rou 柔|ru 如|rui 瑞锐蕊|san 三|sen 森|sha 沙|shan 珊杉山|shang 尚|shao 韶邵少绍|shen 沈|sheng 升声|
shi 施石史|shu 舒淑|shuo 硕|si 思|song 松宋嵩颂|su 苏|sun 孙|ta 塔|tai 台泰|tan 谭檀坛|tang 唐汤|tao 涛陶韬桃|tian 田天恬甜|ting 庭婷廷亭停|tong 彤桐童铜同瞳|wan 婉莞万宛|wang 王汪|wei 维卫魏蔚伟为惟围|wen 文温雯纹闻|wu 吴武坞|xi 溪熙汐淅奚夕西希|xia 夏霞峡|xian 贤先县宪娴仙|
xiang 翔祥湘|xiao 晓肖萧崤|xie 谢解协|xin 欣心昕芯新信|xing 星兴|xiong 熊|xiu 秀修|xu 旭许徐|xuan 轩萱宣|xue 雪薛|ya 雅亚|yan 严妍颜岩燕沿偃堰言延艳焰|yang 杨阳洋|yao 瑶姚遥药尧|ye 叶|yi 逸怡艺益漪意义|yin 音茵尹银|ying 颖莹英|yong 咏勇永墉泳|you 尤悠|yu 宇喻玉雨余羽愉榆渔于与禹|
yuan 源袁沅元媛塬园垣圆原苑|yue 悦月越岳乐约|yun 云韵|ze 泽择|zeng 曾|zhan 展|zhang 章张漳|zhao 赵昭沼|zhe 哲浙喆|zhen 真珍振贞臻|zheng 郑正|zhi 智芝志芷之质|zhong 钟中|zhou 舟周洲|zhu 朱竹珠|zhuo 卓|zi 子紫|zong 宗|zou 邹|zuo 左
"""  # fmt: skip

#: Words that are one slip apart count as one from this Jaro-Winkler likeness and length on, without a fact that says so.
SLIP, LONG = 0.93, 7

_SIMPLE = str.maketrans(_SIMPLER)
_FORMAL = {n: line.split()[0] for line in reversed(_NICKNAMES.replace("\n", " ").split(";")) for n in line.split()}
_GIVEN = {*_FORMAL.values()}
_LONG = {n: line.split()[0] for line in _ABBREVIATIONS.replace("\n", " ").split(";") for n in line.split()}
_INITIALS: dict[str, set[str]] = {}
for _line in _NICKNAMES.replace("\n", " ").split(";"):
    _INITIALS[_line.split()[0]] = {n[0] for n in _line.split()}
_SOUND = {c: line.split()[0] for line in reversed(_SYLLABLES.replace("\n", "").split("|")) for c in line.split()[1]}
# fixed values: characters read otherwise as surnames
_SURNAMES = {"柏": "bai", "曾": "zeng", "单": "shan", "解": "xie", "仇": "qiu", "查": "zha", "任": "ren"}
_HEARD = {*_SOUND.values(), *_SURNAMES.values()}
_HAN = re.compile("[㐀-鿿]")


def bare(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFD", text.casefold())
    return "".join(c for c in text if unicodedata.category(c) != "Mn")


def fold(text: str) -> str:
    """Bare, with ae, oe and ue for umlauts as plain vowels."""
    text = bare(text)
    return text.replace("ß", "ss").replace("ø", "o").replace("ae", "a").replace("oe", "o").replace("ue", "u")


def sounds(name: str) -> list[str]:
    """The syllables of a Chinese name, characters without a known one as they are."""
    return [_SURNAMES.get(name[0]) or _SOUND.get(name[0], name[0]), *(_SOUND.get(c, c) for c in name[1:])] if name else []


def phonetic(word: str) -> str:
    """Consonant classes of a folded Latin word, its first sound kept; like letters and repeats count once."""
    word = word.replace("ph", "f").replace("ck", "k").replace("sch", "s").replace("sh", "s").replace("th", "t")
    code = "".join({"b": "p", "c": "k", "d": "t", "f": "f", "g": "k", "j": "j", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "q": "k", "r": "r", "s": "s", "t": "t", "v": "f", "w": "f", "x": "s", "z": "s"}.get(c, "") for c in word)
    out = "a" if word[:1] in "aeiouyh" else ""
    for c in code:
        if not out or out[-1] != c:
            out += c
    return out


def jaro_winkler(a: str, b: str) -> float:
    """The usual measure, prefix weight 0.1 for up to four characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else b[i + 1 :] == a[i:]


# --- parsing -----------------------------------------------------------------------------


def parse(name: str | None, description: str | None = None, wording: frozenset[str] = frozenset()) -> dict | None:
    """kind (person, org, thing, han_person, han_org), tokens, more (generation, type or acronym), numbers, facts."""
    if not name:
        return None
    text = " ".join(unicodedata.normalize("NFKC", name).split())
    inner = re.findall(r"[(\[（【]([^)\]）】]*)[)\]）】]", text)
    base = re.sub(r"[(\[（【][^)\]）】]*[)\]）】]", " ", text).strip()
    if not base and not inner:
        return None
    latin = re.search(r"[^\W\d_㐀-鿿]", base)
    han = _HAN.search(base)
    numbers = [str(int(x)) for x in re.findall(r"\d+", re.sub(r"(?<=\d)[.](0+)(?!\d)", "", text)) if x.isascii()]
    out = {"numbers": "-".join(numbers), "facts": facts(description, wording), "more": ""}
    if han and not latin:
        return _parse_han(base, inner, out, text)
    if han:
        return out | {"kind": "thing", "tokens": [re.sub(r"[\W\d]+", "", text).lower()]}
    return _parse_latin(base, inner, out)


def _parse_han(base: str, inner: list[str], out: dict, whole: str) -> dict:
    t = re.sub(r"[\W\d_]+", "", base).translate(_SIMPLE)
    t = re.sub(r"[\W\d_]+", "", re.sub(r"[(（](有限|有限责任)[)）]", r"\1", whole)).translate(_SIMPLE) if re.search(r"[(（]有限", whole) else t
    for x in inner:
        if x.startswith("有限"):
            continue
        x = re.sub(r"[\W_]+", "", x).translate(_SIMPLE)
        if _HAN.search(x) and not x.startswith(("简称", "又称", "曾用", "别名")):
            t = x + t if any(t.endswith(k) for k in _HAN_TYPES) else t
    if out["numbers"]:
        return out | {"kind": "thing", "tokens": [t]}
    person = t
    for h in _HONORIFICS:
        if len(t) > len(h) and t.endswith(h):
            person = t[: -len(h)]
    if len(person) <= 3 or (len(person) == 4 and person != t):
        sound = sounds(person)
        return out | {"kind": "han_person", "tokens": [person], "roman": "".join(sorted((sound[0], "".join(sound[1:])))), "more": "" if len(person) > 1 else "weak"}
    t = re.sub(r"^(.{2,4}?)[省市县区镇乡](?=.{4})", r"\1", t)
    t = t.replace("有限责任公司", "有限公司").replace("试验室", "实验室")
    return out | {"kind": "han_org", "tokens": [t]}


def _parse_latin(base: str, inner: list[str], out: dict) -> dict:
    raw = re.findall(r"[^\W\d_]+\.?", base)
    caps = [x for x in raw if len(x.strip(".")) > 1]
    extra = []
    for x in inner:
        words = re.findall(r"[^\W\d_]+", x)
        if not (len(words) == 1 and words[0].isupper() and len(words[0]) <= 6):
            extra += words
    tokens, short, generation, titled, acronym = [], [], "", False, ""
    for x in [*raw, *extra]:
        w = fold(x.strip("."))
        if not w or w in _SMALL and (len(w) > 1 or x.islower()):
            continue
        if w in _GENERATION and len(tokens) >= 1:
            generation = _GENERATION[w]
            continue
        if w in _TITLES and not (w == "eng" and any(fold(y.strip(".")) in _LONG for y in raw if y != x)):
            titled = True
            continue
        if x.strip(".").isupper() and 2 <= len(w) <= 5 and not all(y.strip(".").isupper() for y in caps):
            acronym = w
        formal = _FORMAL.get(bare(x.strip(".")))
        tokens.append(fold(formal) if formal else _LONG.get(w, w))
        short.append(x.endswith(".") and len(w) > 1)
    kind = [w for w in tokens if w in _TYPES] or ["company"] * ("limited" in tokens)
    if kind:
        rest = [w + ("." if s and w not in _LONG.values() else "") for w, s in zip(tokens, short) if w not in _TYPES and w != "limited"]
        return out | {"kind": "org", "tokens": rest, "more": kind[0]}
    if out["numbers"]:
        return out | {"kind": "thing", "tokens": [w for w in tokens if w not in ("v", "version", "ver", "no", "nr", "release")]}
    if acronym and len(tokens) >= 2 and not any(w in _GIVEN for w in tokens) and not _chinese(tokens):
        return out | {"kind": "org", "tokens": [w for w in tokens if w != acronym], "more": "~" + acronym}
    full = [w for w in tokens if len(w) > 1]
    more = generation + ("|weak" if len(full) < 2 else "")
    written = [bare(x) for x in re.findall(r"[^\W\d_]+", base)]
    roman = "".join(sorted(_roman(written))) if len(written) > 1 and _chinese(written) else ""
    return out | {"kind": "person", "tokens": tokens, "roman": roman, "more": more} if tokens else None


def _syllables(word: str) -> bool:
    """Whether a word is a row of Chinese syllables."""
    return not word or any(word[:n] in _HEARD and _syllables(word[n:]) for n in range(1, 7))


def _chinese(tokens: list[str]) -> bool:
    return len(tokens) <= 3 and all(_syllables(w) for w in tokens)


# fixed values: English function words
_STOP = set("a an and as at by for from in is its of on or since the to was with".split())


def facts(description: str | None, wording: frozenset[str] = frozenset()) -> list[str]:
    """What a description states: years (y:), names (n:, capitalised words or Chinese places) and other words (w:), each but function words and ``wording``."""
    if not description:
        return []
    text = unicodedata.normalize("NFKC", description)
    found = [f"y:{y}" for y in re.findall(r"(?<!\d)\d{4}(?!\d)", text)]
    if _HAN.search(text):
        text = re.sub(r"成立|位于|设在|加入|年起|在|任|的|年", " ", text.translate(_SIMPLE))
        return sorted({*found, *(f"n:{x}" for x in re.findall(r"[㐀-鿿]{2}[省市县区镇](?!\w*编号)", text))})
    for w in re.findall(r"[^\W\d_]+", text):
        plain = fold(w)
        if plain not in _STOP and plain not in wording:
            found.append(("n:" if w[0].isupper() else "w:") + plain)
    return sorted(set(found))


def agree(a: list[str], b: list[str], person: bool = True) -> int:
    """1 if both state a common year or name and contradict each other in nothing, -1 if they contradict, 0 if one says too little.

    Years, names and, of a person, other words (the post) contradict if both state some and
    none in common.
    """
    if not a or not b or bool(_HAN.search("".join(a))) != bool(_HAN.search("".join(b))):
        return 0
    common = 0
    for kind in ("y:", "n:", "w:") if person else ("y:", "n:"):
        x, y = ({f for f in side if f.startswith(kind)} for side in (a, b))
        if x and y:
            if not x & y:
                return -1
            common += kind != "w:"
    return 1 if common else 0


def wording(entities: DataFrame, share: float = 0.08) -> frozenset[str]:
    """The words that stand in at least ``share`` of all descriptions: how things are told, not what.

    Counted over all rows; at most the mean number of words over ``share`` come to the driver.
    """
    told = entities.where("description is not null and description rlike '[A-Za-z]'").select(F.array_distinct(F.split(F.lower("description"), r"(?U)[^\p{L}]+")).alias("w"))
    total = told.count()
    often = told.select(F.explode("w").alias("w")).where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= share * total)
    return frozenset(fold(r.w) for r in often.collect())


# --- blocks ------------------------------------------------------------------------------


def _less_one(code: str) -> list[str]:
    return [code, *(code[:i] + code[i + 1 :] for i in range(len(code)))] if len(code) >= 4 else [code]


def block_keys(p: dict) -> tuple[list[str], list[str]]:
    """(keys of the form, keys by which a form that fits too much looks for the others)."""
    n, tokens, kind = p["numbers"], p["tokens"], p["kind"]
    if kind == "thing":
        code = phonetic("".join(w.removesuffix("s") for w in tokens)) if not _HAN.search(tokens[0] if tokens else "") else tokens[0]
        return [f"t{n}:{c}" for c in {code, *_less_one(code)}], []
    if kind == "han_org":
        t = tokens[0]
        ends = t[3:6]
        return [f"o:{c}" for c in {t[:2] + ends[:2], t[1:3] + ends[:2], t[0] + t[2] + ends[:2], t[:3] + ends[1:3], "".join(_SOUND.get(c, c) for c in t[:5])}], []
    if kind == "han_person":
        sound = sounds(tokens[0])
        if len(sound) == 1:
            return [], [f"w:{sound[0]}"]
        return [f"h:{p['roman']}", *(f"c{i}:{sound[0]}{x}" for i, x in enumerate(sound[1:]))], []
    if kind == "org":
        keys = set()
        for w in tokens:
            if len(w.rstrip(".")) >= 5:
                rest = {*p["more"][1:]} if p["more"].startswith("~") else {x[0] for x in tokens if x is not w} or {""}
                keys |= {f"g:{c}:{x}" for c in _less_one(phonetic(w.rstrip("."))) for x in rest}
        return sorted(keys), []
    full = [w for w in tokens if len(w) > 1]
    if len(full) >= 2:
        keys = {f"p:{c}:{i}" for w in full for v in tokens if v is not w for i in _initials(v) for c in _less_one(phonetic(w))}
        return sorted(keys | ({f"h:{p['roman']}"} if p["roman"] else set())), []
    if full and len(tokens) >= 2:
        return [f"p:{c}:{v}" for v in tokens if len(v) == 1 for c in _less_one(phonetic(full[0]))], []
    return [], [f"w:{c}" for w in full for c in _less_one(phonetic(w))]


def _initials(word: str) -> set[str]:
    """The letters by which a word may be written: for given names also those of their nicknames."""
    return {word[0]} | _INITIALS.get(word, set())


def _roman(full: list[str]) -> list[str]:
    """Surname and joined given syllables of a romanised Chinese name such as ji jun qian."""
    if len(full) == 3:
        if all(w in _HEARD for w in full):
            return [full[0], full[1] + full[2]]
    return full


def surname_keys(p: dict) -> list[str]:
    """The keys under which forms of title and surname find a full name."""
    if p["kind"] == "person":
        return [f"w:{c}" for w in p["tokens"] if len(w) > 2 for c in _less_one(phonetic(w))]
    if p["kind"] == "han_person" and len(p["tokens"][0]) > 1:
        return [f"w:{sounds(p['tokens'][0])[0]}"]
    return []


# --- comparison --------------------------------------------------------------------------


def _word(a: str, b: str, known: bool = False) -> float:
    """Likeness of two words; an abbreviation with a point is like the word it begins.

    Jaro-Winkler decides: SLIP and more is one word, in words of LONG letters or more that are
    one slip apart or sound alike. Shorter words and lower values pass (0.92) only where the
    rest is ``known`` to agree, by a fact that both descriptions state. Two given names are two words.
    """
    if a == b:
        return 1.0
    x, y = a.rstrip("."), b.rstrip(".")
    if a != x and y.startswith(x[:-1]) and len(x) >= 3 or b != y and x.startswith(y[:-1]) and len(y) >= 3:
        return 0.95
    like = jaro_winkler(x, y)
    if x in _GIVEN and y in _GIVEN:
        return min(0.85, like)
    if min(len(x), len(y)) >= 4 and (one_edit(x, y) or phonetic(x) == phonetic(y)):
        if known:
            return max(0.92, like)
        if like >= SLIP and max(len(x), len(y)) >= LONG:
            return like
    return min(0.89, like)


def _paired(a: list[str], b: list[str], known: bool = False) -> tuple[float, list[str], list[str]]:
    """(least likeness of the pairs, words left on either side) of the best greedy pairing."""
    options = sorted(((_word(x, y, known), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    mine, other, least = set(), set(), 1.0
    for s, i, j in options:
        if i not in mine and j not in other and s >= 0.86:
            mine.add(i)
            other.add(j)
            least = min(least, s)
    if not mine:
        return 0.0, a, b
    return least, [x for i, x in enumerate(a) if i not in mine], [y for j, y in enumerate(b) if j not in other]


def same(a: dict, b: dict) -> int:
    """2: the same; 1: the same if nothing else fits; 0: no."""
    if a["numbers"] != b["numbers"]:
        return 0
    kinds = {a["kind"], b["kind"]}
    said = agree(a["facts"], b["facts"], kinds <= {"person", "han_person"})
    if kinds == {"person"}:
        return _same_person(a, b, said)
    if kinds == {"org"}:
        return _same_org(a, b, said)
    if kinds == {"han_person"}:
        x, y = a["tokens"][0], b["tokens"][0]
        if x == y:
            return 2 if said >= 0 else 0
        if len(x) != len(y):
            return 0
        # one sound and surname in one base: a slip of writing, if no fact speaks against it
        if sounds(x) == sounds(y) and x[0] == y[0]:
            return 2 if said >= 0 else 0
        return 2 if said > 0 and len(x) == 3 and x[0] == y[0] and sum(c != d for c, d in zip(x, y)) == 1 else 0
    if kinds == {"person", "han_person"}:
        p, h = (a, b) if a["kind"] == "person" else (b, a)
        if p["roman"] and p["roman"] == h["roman"]:
            return 2 if said >= 0 else 0
        return 0
    if kinds == {"han_org"}:
        return _same_han_org(a["tokens"][0], b["tokens"][0], said)
    if kinds == {"thing"}:
        x, y = "".join(a["tokens"]), "".join(b["tokens"])
        if _HAN.search(x + y):
            return 2 if x == y else 0
        trimmed = [re.sub(r"s$", "", w) for w in (x, y)]
        return 2 if said >= 0 and (trimmed[0] == trimmed[1] or one_edit(*trimmed) and min(map(len, trimmed)) >= 8) else 0
    return 0


def _same_person(a: dict, b: dict, said: int) -> int:
    if a["roman"] and a["roman"] == b["roman"]:
        return 2 if said >= 0 else 0
    gen_a, _, weak_a = a["more"].partition("|")
    gen_b, _, weak_b = b["more"].partition("|")
    if gen_a and gen_b and gen_a != gen_b or said < 0:
        return 0
    if bool(gen_a) != bool(gen_b) and said <= 0:
        return 0
    x, y = a["tokens"], b["tokens"]
    full_x, full_y = [w for w in x if len(w) > 1], [w for w in y if len(w) > 1]
    least, rest_x, rest_y = _paired(full_x, full_y, said > 0)
    letters_x, letters_y = [w for w in x if len(w) == 1], [w for w in y if len(w) == 1]
    if not least:
        return 0
    initials = 0
    for rest, letters in ((rest_x, letters_y), (rest_y, letters_x)):
        for w in list(rest):
            fit = [c for c in letters if c in _initials(w)]
            if fit:
                letters.remove(fit[0])
                rest.remove(w)
                initials += 1
    # middle initials of both must be one and the same
    if letters_x and letters_y and not set(letters_x) & set(letters_y):
        return 0
    bare_x, bare_y = len(full_x) == 1 and not letters_x and not initials, len(full_y) == 1 and not letters_y and not initials
    if bare_x or bare_y:
        if least < 0.9 or (bare_x and rest_x) or (bare_y and rest_y):
            return 0
        return 2 if said > 0 else 1
    if rest_x or rest_y:
        return 0
    if initials:
        return 2 if said > 0 else 1
    return 2 if least >= 0.9 or said > 0 else 0


def _same_org(a: dict, b: dict, said: int) -> int:
    if said < 0:
        return 0
    if a["more"].startswith("~") or b["more"].startswith("~"):
        s, t = (a, b) if a["more"].startswith("~") else (b, a)
        if t["more"].startswith("~"):
            return 2 if s["more"] == t["more"] and _paired(s["tokens"], t["tokens"], said > 0)[0] >= 0.92 else 0
        best = max(((_word(s["tokens"][0], w, said > 0), i) for i, w in enumerate(t["tokens"])), default=(0, 0)) if s["tokens"] else (0, 0)
        rest = [w for i, w in enumerate(t["tokens"]) if i != best[1]]
        initials = {"".join(w[0] for w in rest) + t["more"][0], "".join(w[0] for w in t["tokens"]) + t["more"][0]}
        initials |= {x + "l" for x in initials if t["more"] == "company"}
        return 2 if best[0] >= 0.92 and s["more"][1:] in initials else 0
    if a["more"] != b["more"]:
        return 0
    least, rest_x, rest_y = _paired(a["tokens"], b["tokens"], said > 0)
    if least >= (0.86 if said > 0 else 0.9) and not rest_x and not rest_y:
        return 2
    x, y = "".join(a["tokens"]), "".join(b["tokens"])
    return 2 if len(a["tokens"]) != len(b["tokens"]) and min(len(x), len(y)) >= 10 and (one_edit(x, y) or jaro_winkler(x, y) >= 0.97) else 0


def _inside(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def _same_han_org(x: str, y: str, said: int) -> int:
    if said < 0:
        return 0
    if x == y:
        return 2
    short, long = sorted((x, y), key=len)
    if len(long) - len(short) in (1, 2) and short[:2] == long[:2] and _inside(short, long):
        return 2 if long[-1] == short[-1] or long.startswith(short) else 0
    if len(x) == len(y) and sum(c != d for c, d in zip(x, y)) == 1:
        i = next(i for i, (c, d) in enumerate(zip(x, y)) if c != d)
        heard = _SOUND.get(x[i], x[i]) == _SOUND.get(y[i], y[i])
        return 2 if heard and (said > 0 or i < 3) or said > 0 and i < 3 else 1 if i < 3 and len(x) >= 7 else 0
    return 0


# --- the operator ------------------------------------------------------------------------

_FORM = "kb_id string, id string, form string, keys array<string>, seek array<string>, surname array<string>, p string"


def forms(entities: DataFrame) -> DataFrame:
    """One row per entity with a usable name: its parsed form (as JSON in p) and block keys."""
    import json

    usual = wording(entities)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kb, i, name, described in batch.itertuples(index=False):
                p = parse(name, described, usual)
                if p is None or not p["tokens"]:
                    continue
                keys, seek = block_keys(p)
                order = p["tokens"] if p["kind"] != "person" else sorted(p["tokens"])
                form = "|".join([p["kind"], p["numbers"], p["more"], " ".join(order), " ".join(p["facts"])])
                rows.append((kb, i, form, keys, seek, surname_keys(p), json.dumps(p, ensure_ascii=False)))
            if rows:
                yield pd.DataFrame(rows, columns=["kb_id", "id", "form", "keys", "seek", "surname", "p"])

    data = entities.where(F.col("kb_id").isNotNull() & F.col("id").isNotNull()).select("kb_id", "id", F.coalesce("name", "normalized_name").alias("name"), "description")
    return data.mapInPandas(run, _FORM)


def _judge(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, pa, pb) -> a, b, verdict above 0."""
    import json

    @F.pandas_udf("int")
    def verdict(left: pd.Series, right: pd.Series) -> pd.Series:
        held: dict[str, dict] = {}

        def get(t: str) -> dict:
            if t not in held:
                held[t] = json.loads(t)
            return held[t]

        return pd.Series([same(get(x), get(y)) for x, y in zip(left, right)], dtype="int32")

    return pairs.withColumn("verdict", verdict("pa", "pb")).where("verdict > 0").select("a", "b", "verdict")


def _meet(left: DataFrame, right: DataFrame, table: DataFrame, ordered: bool) -> DataFrame:
    """Distinct pairs of forms that share a block, with their parsed names."""
    met = left.join(right, ["kb_id", "key"]).where("a < b" if ordered else "a <> b").select("a", "b").distinct()
    pa, pb = table.select(F.col("form_id").alias("a"), F.col("p").alias("pa")), table.select(F.col("form_id").alias("b"), F.col("p").alias("pb"))
    return met.join(pa, "a").join(pb, "b")


def clusters(entities: DataFrame) -> DataFrame:
    """entity_id, group_id (the smallest id): every entity that has a variant spelling."""
    stage = Stage(entities.sparkSession, "names")
    rows = stage.put(forms(entities))
    first = rows.groupBy("kb_id", "form").agg(F.min("id").alias("form_id"), *[F.first(c).alias(c) for c in ("keys", "seek", "surname", "p")])
    table = stage.put(first)
    members = rows.join(table.select("kb_id", "form", "form_id"), ["kb_id", "form"]).select("id", "form_id")
    keyed = table.select("kb_id", "form_id", F.explode("keys").alias("key"))
    pairs = _meet(keyed.withColumnRenamed("form_id", "a"), keyed.withColumnRenamed("form_id", "b"), table, True)
    seek = table.select("kb_id", F.col("form_id").alias("a"), F.explode("seek").alias("key"))
    surname = table.select("kb_id", F.col("form_id").alias("b"), F.explode(F.array_distinct(F.concat("seek", "surname"))).alias("key"))
    judged = stage.put(_judge(pairs).unionByName(_judge(_meet(seek, surname, table, False))))

    sure = judged.where("verdict = 2").select("a", "b").unionByName(members.where("id <> form_id").select(F.col("id").alias("a"), F.col("form_id").alias("b")))
    known = stage.put(groups.connected_groups(sure, "a", "b"))
    # the weaker cases: a form joins what it fits if that is one cluster only
    weak = judged.where("verdict = 1").select("a", "b")
    weak = weak.unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of = known.select(F.col("member").alias("a"), F.col("group").alias("ga"))
    to = known.select(F.col("member").alias("b"), F.col("group").alias("gb"))
    weak = weak.join(of, "a", "left").join(to, "b", "left").select(F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")).where("ga <> gb")
    single = weak.groupBy("ga").agg(F.min("gb").alias("gb"), F.countDistinct("gb").alias("n")).where("n = 1").select("ga", "gb")
    linked = sure.select("a", "b").unionByName(single.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    final = groups.connected_groups(linked, "a", "b")
    return final.select(F.col("member").alias("entity_id"), F.col("group").alias("group_id"))


def variant_pairs(entities: DataFrame) -> DataFrame:
    """p1_found: entity_id_1 < entity_id_2, all pairs of a cluster.

    Entities without an id, a knowledge base or any letter in their name are left out;
    repeated rows of an id count once; null types and descriptions say nothing.
    """
    c = clusters(entities)
    left = c.select("group_id", F.col("entity_id").alias("entity_id_1"))
    right = c.select("group_id", F.col("entity_id").alias("entity_id_2"))
    return left.join(right, "group_id").where("entity_id_1 < entity_id_2").select("entity_id_1", "entity_id_2")
