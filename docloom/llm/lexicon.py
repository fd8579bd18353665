"""Word classes of the abuse grammar: general vocabulary of English, German and Chinese.

Every entry is (class, forms, words): an underscore stands for a space inside an entry, and
``forms`` names the rule that adds inflected forms (see ``surfaces``).
"""

from __future__ import annotations

from collections.abc import Iterator

# fixed values: general vocabulary
WORDS: list[tuple[str, str, str]] = [
    # --- who is spoken to or about ---
    ("you", "", "you u ya ye yall yourself yourselves thou du dich dir ihr euch 你 你们 您 尔等 你这 你个 你这个 你自己"),
    ("your", "", "your yours ur dein deine deinen deinem deiner deines euer eure euren eurem eurer 你的 你们的 你家"),
    ("they", "", "he she him they them himself herself er sie ihn ihm ihnen 他 她 他们 她们 这种人 那种人 这帮人 那帮人 这群人 那群人 那家伙 这家伙"),
    ("this", "", "this that those these their dieser diese dieses diesem diesen jener jene jenes so_ein so_eine so_einen 这个 那个 这帮 那帮 这群 那群 这些 那些 这种 那种 这 那"),
    ("i", "", "i me we us ich wir mich mir uns 我 我们 咱 咱们 老子 本人"),
    ("my", "", "my our mein meine meinen meinem unser unsere 我的 我们的"),
    ("kin", "noun", "mother father mom mum dad sister brother wife husband family parents child daughter son mutter vater eltern schwester bruder frau familie"),
    ("kin-of", "", "全家 你全家 你们全家 祖宗 你祖宗 你妈 你爸 你娘"),
    ("person", "noun", "man woman guy boy girl person colleague boss manager neighbour neighbor clerk driver mann kerl typ chef kollege kollegin nachbar"),
    ("people", "", "people folk folks men kind tribe lot leute menschen volk bewohner 人 的人 之人 民族"),
    # groups of people by origin, faith, sex, orientation, disability, age or standing
    ("group", "noun", "refugee immigrant migrant foreigner asylum_seeker cripple jew muslim moslem christian catholic protestant hindu sikh buddhist mormon atheist heathen infidel unbeliever black white asian african arab mexican latino hispanic "
     "turk kurd russian ukrainian romanian albanian syrian afghan indian pakistani gypsy gay lesbian homosexual bisexual transsexual queer female feminist islander highlander native savage aborigine peasant beggar pensioner retiree"),
    ("group", "", "women girls roma sinti chinese japanese vietnamese the_disabled disabled_people the_blind the_deaf the_poor the_homeless the_elderly old_people the_unemployed trans_people transgender_people autistic_people"),
    ("group", "denoun", "ausländer flüchtling asylant asylbewerber migrant einwanderer heide ungläubige behinderte krüppel jude muslim moslem christ türke kurde russe araber afrikaner syrer zigeuner schwule lesbe homosexuelle schwarze weib rentner obdachlose arbeitslose bettler"),
    ("group", "", "frauen juden heiden"),
    ("group", "", "难民 移民 外地人 外国人 外来人口 女人 女的 女性 女生 女工程师 残疾人 残废 瘸子 聋子 瞎子 异教徒 犹太人 穆斯林 基督徒 佛教徒 回民 岛民 山民 乡下人 农民工 民工 穷人 乞丐 流浪汉 少数民族 同性恋 黑人 白人 印度人 日本人 韩国人 非洲人 阿拉伯人 老人 老年人"),
    # --- words that bind ---
    ("be", "", "is are am was were be been being remain remains look_like act_like ist sind bist seid bin war waren sein wäre 是 都是 就是 全是 就像 不过是 简直是 真是 根本是 统统是 就是个 真是个 是个 都是些"),
    ("a", "", "a an the such some every all any what only nothing_but just another ein eine einen einem einer der das den dem alle allen jeder jede jedes nur was_für 一个 一群 一帮 一堆 个 所有 全部 只有 的 都"),
    ("very", "", "very so really totally absolute absolutely complete completely utter utterly total real little big fat damn fucking bloody goddamn too and or quite simply always still ganz echt total völlig verdammte verdammter verdammt sehr kleine kleiner kleines und 非常 真 太 简直 彻底 最 大 小 臭 死 老"),
    ("born", "", "born by_birth by_nature by_blood inherently naturally geboren von_geburt von_natur 天生 天生就是 生来 生来就是 骨子里 骨子里就是 本性 本质上"),
    ("neg", "", "not no never neither nor without hardly dont doesnt didnt isnt arent aint cannot wont nicht kein keine keinen keinem keiner keines nie niemals weder ohne 不 没 没有 别 不是 并不是 不会 不要 不能 并非 从不 绝不 绝不能 从来不 未"),
    ("nobody", "", "nobody no_one noone none_of_us niemand keiner 没人 谁都不 谁也不 没有人 谁"),
    ("but", "", "but however rather aber sondern doch jedoch 但 但是 而是 却"),
    ("why", "", "why warum wieso weshalb 为什么 怎么 咋 何不"),
    ("if", "", "if when falls wenn 如果 要是 信不信"),
    ("will", "", "will gonna going_to shall wanna want_to would could 'll werde werden wird würde 会 要 就要 想 一定"),
    ("orelse", "", "before or_else otherwise sonst bevor 就 真想 非要 定要 早晚 迟早 非 不然 否则 再 恨不得"),
    ("must", "", "should must ought need_to needs_to have_to has_to had_better sollten sollte sollen soll müssen muss müsste gehören gehört 应该 应当 必须 就该 都该 该 活该 得 最好 统统 才好"),
    ("hope", "", "hope hopefully wish hoffe hoffentlich wünsche 希望 但愿 祝 盼"),
    # --- talk about what others say, and about such language ---
    ("say", "", "said says told tells wrote writes call calls called calling claimed claims accused accuses alleged alleges shouted yelled quoted quotes argued reportedly sagte sagt sagten schrieb schreibt nannte nennt behauptete behauptet beschimpfte rief 说 说过 骂 骂过 称 声称 写道 叫 喊 指责 据说 转述 引用"),
    ("meta", "", "moderation moderator moderators policy policies guideline guidelines code_of_conduct hate_speech insults slur slurs profanity classifier annotation filter_list forbids prohibits prohibited anti-discrimination discrimination racism sexism antisemitism "
     "moderation moderationsleitfaden leitfaden richtlinie richtlinien hassrede beleidigung beleidigungen schimpfwort schimpfwörter diskriminierung rassismus 审核 举报 辱骂 敏感词 歧视 仇恨言论 规范 守则 不收录 脏话"),
    ("med", "", "doctor doctors patient patients clinic clinical symptom symptoms treatment therapy diagnosis cancer tumour tumor screening anatomy anatomical physiology biology species reproduction reproductive breeding pregnancy contraception gynaecology urology nurse hospital education biopsy vaccine "
     "arzt ärztin patientin patientinnen klinik symptome behandlung therapie krebs vorsorge anatomie fortpflanzung schwangerschaft verhütung krankenhaus 医生 患者 病人 诊所 症状 治疗 癌 筛查 解剖 生殖 繁殖期 怀孕 避孕 医院 教育 护士"),
    # --- insults ---
    ("slur", "noun", "idiot bastard moron imbecile cretin dimwit halfwit half-wit nitwit dumbass jackass asshole arsehole dickhead dipshit shithead fuckhead fuckwit fucktard motherfucker wanker tosser twat prick cunt bitch whore slut scumbag scumball sleazebag douchebag douche dirtbag lowlife loser "
     "retard buffoon simpleton dunce blockhead bonehead airhead numbskull nincompoop ignoramus oaf weirdo pervert coward crybaby hag skank bimbo faggot nigger kike gook wetback towelhead raghead tranny midget deadbeat sleaze crackhead "
     "good-for-nothing ne'er-do-well piece_of_shit piece_of_crap piece_of_garbage piece_of_trash pile_of_shit sack_of_shit bag_of_shit waste_of_space waste_of_oxygen waste_of_air waste_of_skin son_of_a_bitch pondscum"),
    ("slur", "", "scum pieces_of_shit sons_of_bitches a_disgrace a_joke"),
    ("slur", "denoun", "arschloch idiot idiotin vollidiot volltrottel trottel depp depp vollpfosten dummkopf schwachkopf hohlkopf blödmann drecksack drecksau dreckskerl mistkerl miststück mistvieh schweinehund hurensohn hure nutte schlampe fotze wichser penner versager missgeburt spast spasti "
     "affenarsch arsch loser flachzange hackfresse kanake kümmeltürke schwuchtel kampflesbe gesindel abschaum schuft feigling schwein"),
    ("slur", "", "arschlöcher dummköpfe"),
    ("slur", "", "混蛋 人渣 废物 畜生 蠢货 白痴 贱人 杂种 傻逼 傻瓜 傻子 王八蛋 王八 狗东西 婊子 贱货 败类 脑残 智障 蠢猪 笨蛋 狗屎 狗屁 小人 骗子 窝囊废 饭桶 草包 二百五 神经病 变态 流氓 无赖 泼妇 荡妇 骚货 狗娘养的 狗杂种 狗腿子 死肥猪 死胖子 土鳖 丑八怪 不是人 不要脸 没教养 人模狗样 没用的东西 无耻的东西 该死的东西 恶心的东西 下贱的东西 不是东西 什么东西"),
    # insults only where they are said of people
    ("beast", "noun", "pig rat dog swine hog cow donkey ass ape monkey baboon worm maggot weasel snake skunk leech parasite cockroach roach insect louse toad vulture hyena animal beast monster plague pest disease virus jerk creep freak tramp dyke tool clown sheep"),
    ("beast", "", "trash garbage rubbish filth dirt vermin lice swine mice dogshit bullshit worthless_trash"),
    ("beast", "denoun", "ratte sau kuh ziege affe wurm schlange parasit schmarotzer zecke laus tier monster pest seuche krankheit müll dreck ungeziefer abfall kakerlake hund esel"),
    ("beast", "", "hunde affen schweine viecher"),
    ("beast", "", "猪 狗 牲口 老鼠 害虫 蟑螂 寄生虫 禽兽 垃圾 苍蝇 臭虫 蛆 毒瘤 瘟疫 猴子 畜牲 野兽"),
    ("base", "noun", "subhuman untermensch sub-human mongrel degenerate"),
    ("base", "", "less_than_human lower_than_animals not_human not_even_human inferior_race inferior_beings untermenschen untermensch minderwertig minderwertige minderwertiger 劣等人 劣等民族 劣种 低等 下等人 连牲口都不如 牲口不如 猪狗不如 连狗都不如 禽兽不如"),
    ("worse", "", "worse_than lower_than like nothing_but schlimmer_als dümmer_als wie 不如 像 比"),
    ("mean", "adj", "pathetic stupid worthless disgusting brainless despicable vile repulsive retarded moronic idiotic wretched contemptible loathsome revolting spineless gutless mindless witless clueless shameless hateful hideous ugly filthy rotten useless dumb dirty lazy fat smelly stinking inferior "
     "evil greedy sneaky two-faced thick fucked subnormal braindead brain-dead incompetent ignorant nasty creepy lousy"),
    ("mean", "deadj", "nutzlos dreckig widerlich dumm saudumm strohdumm erbärmlich hirnlos wertlos ekelhaft eklig ekelig blöd hässlich faul jämmerlich abartig verkommen verlogen hinterhältig feige unfähig primitiv schmutzig stinkend fett bescheuert behämmert pervers widerwärtig"),
    ("mean", "", "没用的 恶心的 无耻的 下贱的 该死的 愚蠢的 肮脏的 丑陋的 没脑子的 不要脸的 卑鄙的 懒惰的 没用 恶心 无耻 下贱 该死 愚蠢 肮脏 丑陋 没脑子 卑鄙 脏 脏的 蠢 笨 贱 丑 懒 缺德 臭不要脸 没出息 没良心 脑子有病 脑子进水 脑子被狗吃 有病 弱智"),
    ("curse", "", "fuck fucks fick fickt screw damn_you curse_you sod f_off eff 操你 操他 日你 去你的 草泥马 滚你 你妈的 他妈的 妈的 妈逼 fuckyou stfu gtfo leck"),
    ("begone", "", "drop_dead go_to_hell rot_in_hell burn_in_hell piss_off fuck_off sod_off bugger_off eat_shit kiss_my_ass kiss_my_arse go_fuck verpiss_dich fahr_zur_hölle leck_mich 见鬼去 下地狱 给我滚 滚蛋 去死 不得好死 死全家 go_die go_and_die"),
    ("dismiss", "", "get_lost shut_up shut_your_mouth shut_your_trap shut_your_face shut_your_gob crawl_back crawl_under get_out_of_my_sight halt_die_fresse halt_die_klappe halt_dein_maul halt_das_maul halt's_maul "
     "maul_halten verzieh_dich hau_ab zur_hölle scher_dich 滚开 滚吧 快滚 滚出去 闭嘴 住口 滚远点 闭上你的嘴 闭上你的臭嘴 少废话 呸"),
    ("want", "", "want wants miss misses like likes love loves need needs care cares help mourn vermissen vermisst vermissen_würde will mag braucht 想 想你 想看见 想见 想见到 喜欢 要 在乎 待见 需要"),
    # --- death, violence ---
    ("die", "", "die choke suffocate rot perish suffer get_cancer bleed_out croak starve verreck verrecke verrecken verreckst stirb sterben ersticke erstick ersticken erstickst krepier krepiere krepierst 死 早点死 死掉 烂掉"),
    ("suicide", "", "kill_yourself hang_yourself shoot_yourself drown_yourself end_yourself kys end_your_life slit_your_wrists off_yourself kill_urself bring_dich_um bring_dich_doch_um häng_dich_auf erhäng_dich 跳楼 上吊 自杀 自我了断 跳河 吊死自己 死了算了 死了干净"),
    ("jump", "verb", "jump leap throw_yourself"), ("jump", "", "spring spring_doch springst springen stürz 跳"),
    ("high", "", "roof bridge cliff building window balcony tower train dach brücke fenster hochhaus klippe zug 楼 桥 悬崖"),
    ("hurt", "verb", "kill murder stab shoot strangle throttle punch kick slap smash crush bash drown skin gut cut break crack snap rip choke slit hit whip lynch butcher slaughter maim cripple torture hurt bury destroy hunt knife batter rape slice"),
    ("hurt", "deverb", "töt schlag verprügel verdresch erschlag erschieß erwürg erstech stech würg brech zerquetsch vernicht vergewaltig"),
    ("hurt", "", "trete zertrete hau haue prügel prügle zerleg mach_dich_kalt 杀 杀了 打 打死 打断 弄死 砍死 砍 揍 揍死 抽 抽死 掐死 捅 捅死 剁 剁了 宰 宰了 扒了 撕烂 撕碎 废了 整死 烧死 打爆 踢 扇"),
    ("beat", "", "beat verprügle prügle 打"),
    ("finish", "", "end finish get ruin waste deal_with teach fertig"),
    ("bring", "", "bring bringe bringen mach mache machen"), ("um", "", "um fertig kalt"),
    ("part", "noun", "face jaw tooth skull head leg bone neck nose arm knee finger rib throat eye guts brain spine gesicht kiefer zahn schädel kopf bein knochen genick nase hals fresse"),
    ("part", "", "teeth zähne beine fingers knochen 腿 狗腿 头 狗头 脸 嘴 牙 骨头 脖子 手 皮 几巴掌 巴掌 耳光 两巴掌 一顿"),
    ("find", "", "find track hunt_down come visit know look_up finde find_heraus komme weiß kenne 找到 找 知道 去 上 来 查到 堵"),
    ("where", "", "where wo 哪里 哪儿"), ("live", "", "live lives sleep work wohnst wohnt lebst arbeitest 住 住哪 住在 上班"),
    ("home", "", "home house place flat apartment door car office street family kids children haus wohnung tür auto familie kinder 家 家里 房子 门口 你家 家门 孩子 家人"),
    ("torch", "", "burn burning torch burn_down set_fire blow_up bomb zünde zünd fackel abfackeln anzünden 烧 一把火烧 一把火 烧了 炸 炸了 点了"),
    ("regret", "", "regret_this regret_it regret_that pay_for_this pay_for_that pay_for_it be_sorry bereuen büßen 后悔 付出代价 好看 吃不了兜着走"),
    ("dead", "", "dead toast history tot erledigt 死定 死定了 完了 完蛋"),
    ("warn", "", "watch_your_back sleep_with_one_eye_open you're_next pass_auf_dich_auf nimm_dich_in_acht 走着瞧 等着瞧 给我等着 小心点"),
    # --- calls for harm to or exclusion of people ---
    ("harm", "", "shot hanged hung gassed lynched slain exterminated eradicated eliminated liquidated annihilated purged deported expelled sterilised sterilized castrated enslaved banned wiped_out wiped_off wiped_from thrown_out kicked_out driven_out locked_up rounded_up shipped_off shipped_back sent_back put_down put_in_camps interned "
     "cleansed segregated extinct removed_from_this_country die disappear vanish vergast ausgerottet vernichtet abgeschoben ausgewiesen gejagt davongejagt weggejagt rausgeworfen rausgeschmissen eingesperrt weggesperrt erschossen aufgehängt gehängt vertrieben verboten verschwinden sterben an_die_wand ins_lager raus "
     "赶出去 赶走 关起来 消灭 杀光 杀绝 赶尽杀绝 灭绝 清除 清洗 驱逐 驱逐出境 遣返 枪毙 吊死 烧死 绞死 灭掉 绝育 滚出去 滚回去 消失 死绝 死光"),
    ("exterminate", "verb", "exterminate eradicate eliminate deport expel gas lynch annihilate purge sterilise sterilize castrate enslave ban hang shoot kill murder"),
    ("exterminate", "", "wipe_out get_rid_of round_up lock_up hunt_down rottet vergast vertreibt hängt erschießt verbietet 杀光 赶走 消灭 赶出去"),
    ("throw", "", "throw kick drive chase send ship put lock shut string keep let run load march herd wirf werft jagt schickt schick sperrt hängt schmeißt 把 让 将"),
    ("away", "", "out away back up off down abroad on_a_train onto_a_train on_a_boat in_a_camp in_camps home raus weg zurück ab auf ein heim 出去 回去 走 关 船 火车"),
    ("right", "", "deserve deserves deserved worthy fit verdienen verdient wert recht 配 值得"),
    ("unfit", "", "不配 没资格 没有资格 不该有 不值得"),
    ("allowed", "", "allowed permitted entitled dürfen erlaubt 准 允许 让 许"),
    ("unwelcome", "", "unwelcome unerwünscht 不欢迎 不招待 不伺候"),
    ("welcome", "", "welcome serve employ hire trust rent_to willkommen bedienen bedient trau traut traue vertrau vertraut 欢迎 相信 信 招待 接待 雇 信任"),
    ("blame", "", "problem problems crime crimes fault disease misery trouble comes_from caused_by because_of schuld problem probleme verbrechen 问题 罪魁 祸害 都怪 怪"),
    ("from", "", "from of by because_of aus von an 因为 来自"),
    ("breed", "", "breed breeds breeding multiply multiplies infest infests infect swarm vermehren vermehrt 繁殖 下崽 泛滥"),
    ("made", "", "made born created good meant belong belongs only_good gut gehört geschaffen 只配 只会 天生就该 就该"),
    ("menial", "", "scrub clean cook wash sweep mop serve obey kitchen floors toilets slaves slave putzen kochen küche herd gehorchen 洗 打扫 做饭 擦地 伺候 生孩子 厨房 当奴才"),
    # --- sexual ---
    ("sexact", "", "blowjob blowjobs handjob handjobs rimjob deepthroat gangbang threesome creampie cumshot bukkake orgy masturbate masturbates masturbated masturbating masturbation jerking_off jerk_off jacking_off fingered fingering orgasm orgasms cum cumming ejaculated ejaculate climaxed fucked_her fucked_him fucked_me sucking_me_off suck_me_off sucking_off suck_off sucked_off "
     "went_down_on get_laid got_laid eat_her_out ride_me rode_him made_love having_sex had_sex have_sex sex_with came_inside came_in_her until_he_came until_she_came bj orgasmus orgasmen kam_in_ihr gefickt ficken bumsen vögeln gevögelt geblasen blas_mir blasen sex_mit sex_haben wichsen "
     "做爱 上床 口交 自慰 射精 性交 高潮 约炮 一夜情 打飞机 群交 肛交 啪啪 插进 骑在 缠绵 开房 做一次"),
    ("porn", "", "porn porno pornos porns pornstar pornfilm pornofilm xxx hardcore uncensored nsfw hentai sex_tape sex_video sex_videos sexvideo camgirl camgirls escort escorts onlyfans erotic pornografie sexfilm unzensiert unzensierte nacktvideo 色情 色情片 色情片段 黄片 无码 成人视频 成人片 三级片 裸聊 援交 招嫖 小电影 情色"),
    ("nude", "", "nudes nude_pics nude_photos nude_pictures naked_pics naked_photos naked_pictures dick_pic dick_pics tit_pics nacktfoto nacktfotos nacktbild nacktbilder 裸照 裸体照 私密照 裸体视频"),
    ("aroused", "", "horny aroused turned_on hard_for_you wet_for_you wet_for_me so_wet so_hard erection boner hard-on geil notgeil scharf_auf feucht steif steifen 饥渴 欲火 硬了 湿了 发情 性欲"),
    ("sexpart", "", "pussy pussies cock cocks dick dicks penis vagina clit clitoris tits titties boobs boob breast breasts buttocks ass_cheeks crotch thigh thighs genitals between_my_legs between_her_legs between_his_legs between_your_legs "
     "schwanz muschi titten brüste brüsten nippel schenkel eier po zwischen_meinen_beinen zwischen_ihren_beinen 乳房 乳头 胸部 奶子 巨乳 肉棒 阴茎 阴道 私处 下体 屁股 大腿 内裤 胸罩 裤裆"),
    ("touch", "verb", "stroke lick suck grope fondle caress thrust spank straddle penetrate undress strip moan finger kiss taste unzip"),
    ("touch", "", "slid_into stroking licking sucking groping fondling moaning thrusting undressing rode panting stöhnen stöhnte stöhnend stöhnt leckte lecken streichelte griff_nach ausgezogen zog_sich_aus zog_sich_nackt_aus auszieh ausziehen saugte stieß 抚摸 揉 揉着 舔 吸吮 呻吟 脱光 脱光衣服 扒光 脱衣 摸 亲吻 抽插 伸进 娇喘 喘息"),
    ("naked", "", "naked nude topless undressed unclothed nackt nackte nackter 裸 赤裸 全裸 光着身子 一丝不挂 裸体"),
    ("bed", "", "bed tonight knees on_your_knees desk lap heute_nacht bett schoß 今晚 床上 身上 跪下"),
    ("solicit", "", "send show want_to let_me come picturing imagining imagine dream_of dreaming_of singles hot meet free watch click add schick zeig will_dich 发 看 给我 来 想 想跟你 免费 免费看 加 加号 美女"),
    ("film", "", "clip clips video videos film films tape photo photos picture pictures link streams clip 视频 片 片段 照片 影片"),
    ("sexword", "", "sex sexy sexual sexually porny kinky slutty naughty erotik sexuell 性 性感"),
]

_DE_ADJ = ("", "e", "er", "en", "es", "em", "ere", "sten")
_DE_NOUN = ("", "s", "e", "en", "er", "n", "ern", "in", "innen")
_DE_VERB = ("", "e", "en", "t", "st")


def surfaces(forms: str, word: str) -> Iterator[tuple[str, str]]:
    """(form, suffix of its class): the inflected forms; participles of verbs of violence are their own class."""
    if forms == "noun":
        stem = word[:-1] + "ies" if word.endswith("y") and word[-2] not in "aeiou" else word + ("es" if word.endswith(("s", "x", "ch", "sh")) else "s")
        yield from ((w, "") for w in (word, word + "s", stem))
    elif forms == "verb":
        stem = word[:-1] if word.endswith("e") else word + word[-1] if word[-1] in "bgnpt" and word[-2] in "aeiou" and word[-3] not in "aeiou" else word
        yield from ((w, "") for w in (word,))
        yield from ((w, "-s") for w in (word + "s", word + "es", stem + "ing"))
        yield from ((w, "-ed") for w in (stem + "ed",))
    elif forms == "adj":
        yield from ((w, "") for w in (word, word + "er", word + "est", word + "s"))
        yield from ((word + e, "") for e in ("es", "e", "en"))  # mixed speech: "wertloses piece"
    elif forms in ("deadj", "denoun", "deverb"):
        yield from ((word + e, "") for e in {"deadj": _DE_ADJ, "denoun": _DE_NOUN, "deverb": _DE_VERB}[forms])
    else:
        yield word, ""


def classes() -> dict[str, str]:
    """Surface form (spaces as such) -> class; the first entry of a form stands."""
    out: dict[str, str] = {}
    for name, forms, words in WORDS:
        for word in words.split():
            for form, more in surfaces(forms, word.replace("_", " ")):
                out.setdefault(form, name + more)
    return out
