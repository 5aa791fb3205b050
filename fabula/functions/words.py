"""Word lists and tables that results must agree on."""

# Words of the sentence sentiment.
EN_POSITIVE = "good great joy happy love hope bright beautiful triumph warm kind wonderful excellent".split()
EN_NEGATIVE = "bad dark grief hate fear pain cold loss death despair horrible terrible sad".split()
ZH_POSITIVE = "高兴 开心 美丽 棒 爱 成功 幸福 感谢 满意 喜欢 胜利 希望 精彩 好 美 佳 喜悦".split()
ZH_NEGATIVE = "悲伤 痛苦 生气 讨厌 失败 疼 差 可惜 孤独 难过 绝望 惨 痛 杀 死 哭 恨 恐惧".split()
JA_POSITIVE = "嬉しい 楽しい 美しい 素晴らしい 愛する 成功 幸せ 感謝 満足 喜ぶ 希望 勝利 笑 喜 好 幸 美 勝 善 優 愛 快 願 助け 安心 可愛い 最高 光 輝く 仲間 笑顔 微笑 平和 素直".split()
JA_NEGATIVE = "悲しい 苦しい 怒る 嫌い 失敗 痛い 最悪 残念 孤独 恐ろしい 絶望 憎い 怒 恐 痛 死 殺 嫌 害 泣 苦 壊 悪 怖 逃 悲 魔物 敵 倒す 襲う 闇 絶望 怪我 暗い 問題 困る 泣く 悲傷 涙 残酷".split()

# Body sensations and direct emotions.
EN_BODY_PHRASES = [
    "tightening chest", "cold sweat", "white knuckles", "pale face", "racing heart", "lump in throat", "goosebumps", "trembling hands", "clenched jaw",
    "heavy breath", "shiver down", "blood ran cold", "stomach churned", "heart pounding", "flushed face", "blushing", "trembling", "choked up", "gasping",
    "pulse raced", "stiffened", "chest tightened", "gooseflesh", "shivering", "clenched fist", "palpitations", "dizzy",
]
EN_BODY_WORDS = "chest sweat knuckles throat heartbeat pulse stomach spine breath jaw shiver tears blush gasp choke".split()
EN_DIRECT_EMOTIONS = (
    "afraid sad happy angry joyful terrified furious grieved delighted anxious depressed excited disgusted scared sorrowful cheerful fearful enraged elated sorrow "
    "happiness grief anger fear joy sadness hate disgust horror panic melancholy contentment despair"
).split()
JA_BODY_WORDS = "心臓 冷や汗 鳥肌 手が震え 息が荒 青ざめ 胸が締め 脈 冷汗 震え 汗 身震い 喉 血が引く".split()
JA_DIRECT_EMOTIONS = "悲しい 嬉しい 怒る 怖い 寂しい 楽しい 喜ぶ 不安 恐ろしい 憎い 幸せ 絶望".split()
ZH_BODY_WORDS = "心跳 冷汗 鸡皮疙瘩 颤抖 脸色发白 面色苍白 握紧拳头 呼吸急促 额头冷汗 咬紧牙关 哽咽 脉搏 心惊肉跳 发抖".split()
ZH_DIRECT_EMOTIONS = "难过 高兴 害怕 愤怒 伤心 快乐 恐惧 伤感 讨厌 绝望 焦虑 开心 激动".split()

# Markers of time.
EN_TIME_MARKERS = [
    "before", "after", "earlier", "later", "years ago", "decades ago", "months ago", "formerly", "once upon a time", "meanwhile", "then", "soon", "when", "since",
    "until", "yesterday", "tomorrow", "already", "previously", "beforehand", "reminisced", "retrospect", "used to", "back then", "recalled", "flashback",
    "in the past", "former", "latter", "history", "long ago",
]
JA_TIME_MARKERS = "昔 かつて 当時 あの頃 あのとき 記憶 思い出 振り返 突然 その時 それ以来 以前 昨日 明日".split()
ZH_TIME_MARKERS = "记得 曾经 当时 那时 那一刻 那一天 那一年 回忆 往事 突然 从前 以前 过去 那个时候 昨天 明天 当年 昔 尝 乃 后 先 方 适 忽 既 遂 临 未几 俄而 异日 昔者 初 末 比 寻 向 向者 往日".split()
EN_PAST = "[\\p{L}\\p{N}_]+ed|was|were|had|did|said|went|came|took|thought|saw|felt|knew|looked|made|told|gave|found|became"
EN_PRESENT = "[\\p{L}\\p{N}_]+s|[\\p{L}\\p{N}_]+ing|is|are|am|have|has|do|does|says|goes|comes|takes|thinks|sees|feels|knows|looks|makes|tells|gives|finds|becomes"
CJK_PAST = "た|形|了|过|已|既|尝|毕|讫|矣|遂|乃"

# Explicit themes.
EN_DIDACTIC = [
    "the true meaning of", "the lesson here was", "with the power of", "the moral of", "in the end", "what matters most", "the nature of", "real meaning of",
    "purpose of life", "true value of", "essence of", "meaning of", "lesson", "purpose", "moral", "destiny", "fate",
]
EN_EPIPHANIC = "realized realize learned learn understood understand discovered discover comprehended recognized recognize decided decide believed believe remembered remember knew".split()
EN_THEMES = "love life death truth friendship power destiny fate courage sacrifice family hope justice humanity peace war freedom honor trust soul heart world strength".split()
JA_DIDACTIC = "本当の意味 教訓 人生の意義 大切なのは 真の価値 命の意味 結局のところ 心の底から 生きる意味 友情の力".split()
JA_EPIPHANIC = "悟った 気づいた 理解した 学んだ 見出した 知った 決めた 信じた".split()
JA_THEMES = "愛 命 死 真実 絆 運命 希望 正義 平和 世界 力".split()
ZH_DIDACTIC = "道理是 真正的意义 生命的真谛 教训是 人生的意义 这告诉我们 真正的力量 终究 生命的意义 真实含义 核心道德 天下大势 分久必合 合久必分 天意 兴亡 大势 成败 治乱 此乃 天命 盛衰 道德 仁义 忠义 英雄 社稷 天道".split()
ZH_EPIPHANIC = "悟出 领悟 明白 懂得 体会到 意识到 学到 看清 明白 决定 悟 感 叹曰 知 识 明 见 决 省 觉".split()
ZH_THEMES = "爱 生命 死亡 真理 友情 命运 希望 正义 和平 勇气 世界 力量 义 忠 国 天下 君 臣 生 死 成 败 志 道 大义 安危".split()

# Word endings and closed classes.
EN_WORLD_ADJECTIVE = "(ful|ous|ive|able|al|ic)$"
EN_WORLD_VERB = "(ed|ing)$|^(is|was|were|are|be|been|have|had|has|do|did)$"
EN_ADJECTIVE = "(ful|ous|ive|able|al|ic|y|ish|less|ent|ant|ary|ory)$"
EN_VERB = "(ed|ing|es|s)$|^(is|was|were|are|be|been|have|had|has|do|did|go|went|come|came|make|made|know|knew|think|thought|see|saw|take|took|say|said)$"
EN_CLAUSE = "that|which|who|whom|whose|because|although|though|if|when|where|while|unless|since|until|and|but|or"
PLACE = "Kingdom|Empire|Capital|City|Town|Village|Forest|Mountain|River|Sea|Castle|Palace|Tower|Domain|Territory"

# Punctuation classes.
EN_PUNCTUATION = "[.,/#!$%^&*;:{}=\\-_`~()?\"']"
JA_PUNCTUATION = "[、。！？「」『』（）―…ー・]"
ZH_PUNCTUATION = "[，、。！？；：\"‘’（）《》【】『』「」—…]"

# Knots of the percentile curves (each curve runs from 0.05 to 0.95).
CURVES = {
    "ttr": [0.20, 0.25, 0.30, 0.35, 0.38, 0.42, 0.45, 0.48, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80],
    "dialogue_ratio": [0.02, 0.05, 0.08, 0.12, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.62, 0.68, 0.75, 0.80],
    "punc_density": [0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20, 0.23, 0.25],
    "dep_tree_depth": [1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 8.5],
    "avg_sentences_per_paragraph": [1.2, 1.8, 2.5, 3.2, 4.0, 5.0, 6.2, 7.5, 9.0, 11.0],
    "theme_explication_ratio": [0.0, 0.1, 0.3, 0.6, 1.0, 1.5, 2.2, 3.0, 4.0, 5.2, 6.5, 8.0, 10.0, 12.5, 15.0],
    "linearity_subversion_score": [0.001, 0.01, 0.03, 0.05, 0.08, 0.11, 0.14, 0.17, 0.20, 0.24, 0.28, 0.33, 0.38, 0.44, 0.50, 0.58, 0.68, 0.80, 0.95, 1.15, 1.40],
    "sensory_body_density": [0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.72, 0.78, 0.85, 0.90],
    "outside_world_engagement": [0.5, 0.8, 1.2, 1.6, 2.0, 2.5, 3.0, 3.6, 4.2, 5.0, 6.0, 7.2, 8.5, 10.0, 12.0],
    "narrative_feature_diversity": [0.0, 0.11, 0.22, 0.33, 0.44, 0.55, 0.66, 0.77, 0.88, 1.0],
    "temporal_shift_score": [0.01, 0.03, 0.06, 0.10, 0.15, 0.20, 0.26, 0.33, 0.40, 0.50, 0.62, 0.75],
    "avg_sentence_len": [5.0, 8.0, 10.0, 12.0, 14.0, 16.0, 18.0, 20.0, 23.0, 26.0, 30.0, 35.0],
    "verb_ratio": [0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20, 0.22, 0.24, 0.26, 0.28, 0.30, 0.32, 0.34, 0.36],
    "compound_sentiment": [-0.80, -0.50, -0.25, -0.10, 0.0, 0.10, 0.25, 0.40, 0.55, 0.70, 0.85, 0.95],
    "word_count": [500, 1500, 3000, 5000, 8000, 12000, 18000, 25000, 35000, 50000, 75000, 100000],
    "sentence_count": [20, 50, 100, 200, 400, 700, 1000, 1500, 2200, 3000, 4500, 6000],
    "adj_ratio": [0.02, 0.04, 0.06, 0.08, 0.10, 0.12, 0.14, 0.16, 0.18, 0.20, 0.23, 0.26],
    "pron_ratio": [0.02, 0.05, 0.08, 0.11, 0.14, 0.17, 0.20, 0.23, 0.26, 0.30, 0.34, 0.38],
    "entity_density": [0.01, 0.03, 0.05, 0.08, 0.11, 0.14, 0.18, 0.22, 0.27, 0.33, 0.40, 0.50],
    "char_count": [1500, 4000, 8000, 15000, 25000, 40000, 60000, 90000, 130000, 180000],
    "kanji_ratio": [0.10, 0.15, 0.20, 0.25, 0.28, 0.32, 0.35, 0.38, 0.42, 0.46, 0.50],
    "particle_ratio": [0.10, 0.15, 0.18, 0.22, 0.25, 0.28, 0.31, 0.34, 0.37, 0.40],
}

# The metrics of an archetype, and each archetype's percentiles of them.
ARCHETYPE_METRICS = [
    "ttr", "dialogue_ratio", "punc_density", "dep_tree_depth", "verb_ratio", "avg_sentences_per_paragraph", "compound_sentiment", "theme_explication_ratio",
    "linearity_subversion_score", "sensory_body_density", "outside_world_engagement", "narrative_feature_diversity",
]
ARCHETYPES = {
    "Philosophy": [0.85, 0.15, 0.60, 0.85, 0.35, 0.70, 0.30, 0.90, 0.60, 0.20, 0.40, 0.80],
    "Poetry": [0.90, 0.10, 0.75, 0.90, 0.30, 0.80, 0.50, 0.70, 0.70, 0.85, 0.50, 0.90],
    "Tragedy": [0.75, 0.40, 0.55, 0.75, 0.45, 0.60, 0.15, 0.70, 0.60, 0.65, 0.50, 0.70],
    "Supernatural": [0.80, 0.25, 0.50, 0.80, 0.45, 0.65, 0.35, 0.60, 0.65, 0.85, 0.60, 0.75],
    "Historical": [0.75, 0.30, 0.45, 0.75, 0.45, 0.60, 0.45, 0.65, 0.40, 0.75, 0.90, 0.75],
    "Fantasy": [0.70, 0.40, 0.45, 0.65, 0.50, 0.50, 0.50, 0.55, 0.45, 0.70, 0.80, 0.75],
    "Sci-Fi": [0.75, 0.35, 0.40, 0.70, 0.45, 0.50, 0.45, 0.60, 0.50, 0.40, 0.85, 0.75],
    "Mystery": [0.65, 0.55, 0.45, 0.55, 0.55, 0.40, 0.40, 0.45, 0.75, 0.60, 0.60, 0.65],
    "Horror": [0.75, 0.30, 0.50, 0.70, 0.50, 0.55, 0.20, 0.50, 0.60, 0.90, 0.50, 0.65],
    "Romance": [0.55, 0.70, 0.45, 0.45, 0.50, 0.35, 0.70, 0.35, 0.40, 0.70, 0.40, 0.50],
    "Action / Adventure": [0.60, 0.45, 0.40, 0.45, 0.65, 0.35, 0.50, 0.30, 0.45, 0.75, 0.75, 0.60],
    "Comedy": [0.60, 0.65, 0.50, 0.40, 0.55, 0.30, 0.80, 0.30, 0.50, 0.50, 0.45, 0.55],
    "Drama": [0.65, 0.60, 0.45, 0.55, 0.50, 0.40, 0.45, 0.60, 0.50, 0.60, 0.50, 0.65],
    "Slice of Life": [0.50, 0.60, 0.40, 0.40, 0.50, 0.30, 0.70, 0.25, 0.35, 0.50, 0.40, 0.45],
    "Cultivation": [0.50, 0.45, 0.40, 0.45, 0.55, 0.30, 0.45, 0.50, 0.50, 0.80, 0.70, 0.55],
    "Isekai": [0.45, 0.65, 0.50, 0.35, 0.55, 0.25, 0.60, 0.30, 0.50, 0.65, 0.45, 0.45],
    "Progression Fantasy": [0.48, 0.55, 0.45, 0.40, 0.60, 0.25, 0.50, 0.40, 0.45, 0.70, 0.65, 0.50],
}
# The archetypes of web novels; the others are of classic literature.
WEB_ARCHETYPES = ["Slice of Life", "Cultivation", "Isekai", "Progression Fantasy"]

# The parent genres, in the order in which tags are tried.
GENRE_PRIORITY = [
    "Isekai", "Cultivation", "Progression Fantasy", "Slice of Life", "Poetry", "Tragedy", "Philosophy", "Supernatural", "Mystery", "Horror", "Historical", "Sci-Fi",
    "Fantasy", "Drama", "Comedy", "Romance", "Action / Adventure",
]
# The tags of each parent genre.
GENRE_TAGS = {
    "Isekai": "isekai|reincarnation|reincarnated|transmigration|another world|summoned hero|tensei|穿越|转生|異世界|転生",
    "Cultivation": "cultivation|xianxia|wuxia|xuanhuan|immortal cultivation|修仙|仙侠|玄幻",
    "Progression Fantasy": "progression fantasy|progression|litrpg|gamelit|system|level system|weak to strong|tower climbing|dungeon core|系统流",
    "Slice of Life": "slice of life|slow life|daily life|cooking|farming|village life|school life|cozy|种田|日常|学園",
    "Poetry": "poetry|poems|sonnets|ballads|verse",
    "Tragedy": "tragedy|tragedies|fatalism",
    "Philosophy": "philosophy|philosophical fiction|ethics",
    "Supernatural": "supernatural|ghosts|apparitions|spirits|spirit beasts",
    "Mystery": "mystery|detective|crime|detective and mystery stories",
    "Horror": "horror|horror tales|gothic fiction|gothic",
    "Historical": "historical|historical fiction|regency fiction|court intrigue",
    "Sci-Fi": "science fiction|sci-fi|time travel|time loop|mecha|apocalypse|space opera",
    "Fantasy": "fantasy|fairy tales|mythology|magic|sword and sorcery|kingdom building|alchemy",
    "Drama": "drama|plays|family life|found family",
    "Comedy": "comedy|humorous stories|satire|humor",
    "Romance": "romance|romance fiction|love stories|slow burn|lovers",
    "Action / Adventure": "action|adventure|sea stories|pirates|sea voyage|martial arts|sword arts|revenge",
}

# Markers of overlapping tropes.
MONSTERS = "skeleton|demon lord|demon king|vampire|ghost|lich|undead|necromancer|zombie|monster|creature|fiend|spectre|骷髅|魔王|吸血鬼|幽灵|僵尸|怪兽|怪物|魔兽".split("|")
FEARS = "dread|spine-chilling|grotesque|horrifying|unspeakable horror|terror|chilling|uncanny|creeping fear|mutilated|macabre|gruesome|eldritch|terrifying|horror|fear|gothic|恐怖|惊悚|灵异|鬼怪|凶宅|阴尸|诡异".split("|")
PURE_SCIFI = "spaceship|cyberpunk|interstellar|alien|galactic empire|dystopia|starship|quantum|nanite|android|warp drive|星际|末世|机甲|科幻|赛博朋克|太空|战舰".split("|")
SYSTEMS = "status window|level up|stat point|vrmmo|system notification|skill point|dungeon|quest log|inventory slot|系统|加点|属性面板|任务日志|面板".split("|")
CULTIVATION_CORE = (
    "qi|dantian|cultivation|cultivator|sect|qi cultivation|tribulation|meridian|meridians|spiritual root|alchemy furnace|pill refining|elixir refining|dan refining|golden core|"
    "foundation building|jianghu|courting death|young master of the clan|young master of the sect|escort agency|internal energy|acupoint|bottleneck|nascent soul|spirit stone|"
    "jade slip|heavenly tribulation|xianxia|wuxia|xuanhuan|修仙|仙侠|修真|玄幻|武侠|功法|宗门|丹药|金丹|元婴|道士|灵石|神通|渡劫|掌门|仙尊|仙帝|洪荒|大罗|炼丹|飞升|剑仙|道尊|神尊|魔尊|"
    "妖帝|法宝|筑基|炼气|真仙|天劫|老祖|洞府|神功|心法|灵气|突破|成仙"
).split("|")
OTHER_WORLDS = "reincarnation|reincarnated|reincarnate|transmigration|transmigrated|transmigrate|another world|other world|different world|summoned hero|summoned|truck-kun|reborn|isekai|tensei|穿越|重生|转生|穿书|快穿|异界|异世|魂穿".split("|")
HARD_CULTIVATION = "dantian|meridian|qi gathering|foundation establishment|nascent soul|pill refining|spirit stone|bottleneck|breakthrough|丹田|经脉|煉氣|炼气|築基|筑基|元嬰|元婴|靈石|灵石|突破|瓶頸|瓶颈".split("|")
MILITARY_EPIC = (
    "army|general|military|emperor|rebellion|troops|strategy|dynasty|warlord|mandate of heaven|cavalry|imperial court|siege|battalion|legion|infantry|fortress|battlefield|conquest|campaign|"
    "将军|將軍|军队|軍隊|皇帝|朝廷|叛乱|叛亂|天下|诸侯|諸侯|兵马|兵馬|城池|谋士|謀士|官军|官軍|大将|大將"
).split("|")
WEB_MARKERS = ["[", "]", "level ", "hp", "mp", "mana", "system", "reincarnat", "transmigrat", "cheat skill", "stats", "cultivat", "dao", "sect", "dungeon", "truck-kun", "archmage", "quest", "grimoire", "holographic"]
