"""Words and patterns of the labelling rules."""

# Words and patterns that the labels depend on.
NEGATION_TOKENS = ["不", "没", "无", "非", "别"]
NEGATION_PREFIXES = ["不太", "不够", "不算", "不是", "并不", "并非", "没有", "没那么"]
NEGATION_EXEMPT = ["不", "没", "无"]
ENGLISH_NEGATION = r"(?iU)(?:\bno\b|\bnot\b|\bdon't\b|\bdoesn't\b|\bdidn't\b|\bnever\b)\s*$"
NEGATION_SUFFIX = "不好|并不好|不太好|不是很好|不佳|不准|不行|不对|较差|很差|太差|偏差|失真"
TURN_WORDS = "但是|不过|但|然而|只是"
SENTENCE_ENDS = r"[。！？!\?\n]+"
SHORT_CONTEXT = "画面|播放|系统|界面|运行|游戏|投屏|对焦|卡顿|延迟|噪音|风扇"
SHORT_ALLOWED = ["值"]
NEGATIVE_LABEL = "差|不足|不清|不准|模糊|卡顿|故障|失真|偏色|发灰|发白|吵|噪音|刺眼|太亮|太暗|不值|慢|失败|断连|过热|烫|粗糙|廉价|太假|假得明显"
POSITIVE_LABEL = "好|满意|清晰|准确|自然|稳定|顺滑|流畅|静音|舒适|精准|丰富|便携|值|划算|耐用"
DEGREES = [("非常|特别|极其|太|超|超级", 4), ("很|比较", 2), ("有点|稍微|略", 1)]
ANALOGY = "像|好像|类似"
BETTER_THAN = "(比.{0,12}(好|更好|更清晰|更亮|更稳|更流畅)|better than|more stable than|clearer than|brighter than)"
WORSE_THAN = "(不如.{0,12}|没有.{0,12}(好|清晰|稳定|流畅)|比.{0,12}(差|更差|更糟)|worse than|not as .{0,12} as|inferior to)"
RESOLVED = "退货|换货|换新|替换|补发|修复|修好|解决|replac|refund|fixed|resolved"
SATISFIED_NOW = "(现在|目前|后来|之后|最终|最后).{0,16}(满意|很好|不错|正常|推荐)|now.{0,16}(happy|satisfied|works)"
THIS_ITEM_GOOD = (
    r"(?iuU)((this|the)\s+(one|tree|plant).{0,40}(great|good|recommend|love|worth|realistic|nice))|"
    r"(this\s+one.{0,20}(is|looks|feels).{0,20}(great|good|nice|realistic|worth))|"
    r"(这个(款|树|植物).{0,20}(很好|不错|推荐|喜欢|值得|逼真))"
)
PRICE_CONCESSION = "(但|但是|不过|然而|只是|but|though).{0,20}(这个价位|这个价格|价位来说|for the price|at this price)"
EXPECTATION = "本来以为|原以为|以为|没想到|超出预期|高于预期|better than expected|exceeded expectations"
CLAIM_MISMATCH = "(宣传|标称|写的是|宣称|advertis|claimed|listed as).{0,30}(实际|其实|only|却|but).{0,20}"
OTHER_PRODUCT = (
    r"(?iU)(?:\b(other|others|another)\b.{0,40}\b(bad quality|poor quality|cheap|fake|plastic|not good|low quality)\b)|"
    r"(?:其他.{0,30}(质量差|做工差|太假|廉价|塑料感强))"
)
EARLIER_PRODUCT = "(?i)(return(?:ed)?|退回|退货|换过|试过).{0,50}(bad quality|poor quality|cheap|质量差|质量不好|做工差|廉价)"
EASY_CARE = "易于护理的替代品|easy-care alternative|easy care alternative|low maintenance alternative"
EASY_CARE_HEADER, EASY_CARE_LABEL = "核心痛点", "不想维护"
# The opposite of a label, as results depend on it.
OPPOSITES = {
    "清晰": "模糊", "很清楚": "模糊", "文字清晰": "模糊", "色彩好": "色彩差", "色彩准确": "偏色", "亮度满意": "亮度不足", "亮度不错": "亮度不足",
    "流畅": "系统卡顿", "稳定": "断连", "静音": "噪音大", "音质好": "音质差", "容易掉": "不掉叶", "掉叶严重": "不掉叶", "有异味": "没有异味",
    "假得明显": "非常逼真", "材质差": "材质好", "质量差": "质量好", "不稳": "很稳固", "容易倒": "很稳固",
}
# Headers that take several labels.
MULTI_HEADERS = ["外观标签", "用户体验标签", "功能标签"]
# Groups of labels of which one stays: of SIZE_GROUP the first in the text, of the others the first here.
SIZE_GROUP = ["尺寸小", "尺寸大", "尺寸合适", "尺寸错误"]
EXCLUSIVE = {
    "外观标签": [["颜色不好看", "颜色好看"], ["外观不好看", "外观好看"]],
    "用户体验标签": [["坐感偏硬", "坐感一般", "坐感舒适"], ["支撑不够", "靠背支撑好"]],
    "功能标签": [["垫薄", "厚垫"]],
}
