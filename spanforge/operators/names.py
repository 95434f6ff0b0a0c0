"""Word lists for names in Han text.

Surnames are a parameter: the default holds the most common ones, a full list
comes from a lexicon file. All other lists are fixed values of the task.
"""

from __future__ import annotations

#: The hundred most common surnames or so; pass your own for more.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤明伍东"

# Lists that the rules and their results depend on.
NICKNAME_PREFIXES = "小阿"
PERSON_STOP = ("陆军", "田间", "高昂", "元和", "王国", "林业", "马路", "于此", "方向", "和平", "华夏")
PERSON_STARTS = (*PERSON_STOP, "全国", "文艺", "别可", "熊猫", "伊军", "明天", "成本", "管理", "申请", "公告", "通用", "平台", "相传")
COMPOUND_SURNAMES = (
    "欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公羊", "赫连", "澹台", "公冶", "宗政", "濮阳", "淳于", "单于", "太叔", "申屠", "公孙", "仲孙", "轩辕", "令狐", "钟离", "宇文", "长孙", "慕容", "鲜于", "闾丘", "司徒", "司空",
)
PLACE_SUFFIXES = (
    "特别行政区", "自治区", "自治州", "自治县", "半岛", "群岛", "省", "市", "县", "区", "镇", "乡", "村", "州", "盟", "旗", "岛", "山", "河", "湖", "湾", "港", "路", "街", "巷", "洲", "国", "郡", "府", "城",
)
PLACE_BAD_SUFFIXES = ("医院", "学校", "大学", "学院", "法院", "政府", "公安局", "派出所", "电视台", "图书馆", "公司", "委员会")
CORE_PLACES = (
    "中国", "北京", "上海", "天津", "重庆", "广州", "深圳", "杭州", "南京", "武汉", "成都", "西安", "长沙", "苏州", "日本", "东京", "美国", "英国", "法国", "德国", "加拿大", "澳大利亚", "新加坡", "亚洲", "欧洲", "非洲",
)
CORE_PLACES_MORE = (*CORE_PLACES, "巴黎", "长春")
PLACE_STOP = (
    "医院", "学校", "法院", "小区", "市委", "公园", "政府", "公安", "公安局", "派出所", "酒店", "广场", "城区", "公交", "小学", "学院", "机场", "图书馆", "公路", "电视台", "大陆", "南方",
)
PLACE_STOP_MORE = (*PLACE_STOP, "全国", "我国", "城市道路", "道路", "马路", "铁路", "水路", "线路")
PLACE_BAD_FRAGMENTS = ("部分地区", "偏远地区", "贫困山区", "国旗", "军旗")
PLACE_BAD_PREFIXES = ("盘活",)
ORG_SUFFIXES = ("大学", "人民医院", "科技有限公司", "数据研究院", "商业银行", "智算中心", "联合实验室", "产业集团", "技术委员会", "证券交易所", "科学院", "计算所", "人民政府", "中心医院")
ORG_SUFFIXES_MORE = (
    "科技有限公司", "人民医院", "证券交易所", "联合实验室", "技术委员会", "有限公司", "研究院", "科学院", "计算所", "研究所", "委员会", "交易所", "实验室", "公安局", "派出所", "人民政府", "医院", "大学", "学院", "银行", "中心", "政府",
)
ALL_ORG_SUFFIXES = tuple(dict.fromkeys((*ORG_SUFFIXES, *ORG_SUFFIXES_MORE)))
ORG_STOP = ("基础设施投资银行",)
BAD_STARTS = "的了"
RESERVED = ("阿明", "星澜智算研究院", "长春", "云海新区", "海州市人民医院", "王小明", "东湖区", "小王", "雷锋", "日本", "东京", "上海证券交易所")
ANCHORS = ("阿强", "小李", "王大明", "赵云", "中国", "北京", "法国", "巴黎", "南湖区", "深圳证券交易所", "云海数据研究院", "南京")
LEFT_CUES = {
    "PER": ("采访了", "采访", "联系了", "联系", "会议由", "欢迎", "提到了", "提到", "昨日", "由", "派"),
    "LOC": ("长期居住在", "居住在", "正在驶向", "活动将在", "驶向", "前往", "抵达", "位于", "来自", "回到", "进入", "访问", "在", "从", "向", "到", "赴"),
    "ORG": ("报告由", "会议在", "访问了", "加入了", "我们与", "成立的", "成立", "拘捕", "这个", "代表", "访问", "加入", "与", "由", "在"),
}
RIGHT_CUES = {
    "PER": ("明天参加", "今天发表", "参加", "发表", "主持", "负责", "抵达", "到访", "到", "加入", "代表", "精神", "工作"),
    "LOC": ("市长", "今天出现", "今天降温", "开展", "发布", "返回", "附近", "出发", "举行", "调研", "迎来", "出现", "访问"),
    "ORG": ("发布", "签署", "完成", "提交", "招聘", "宣布", "召开", "正在", "访问", "派"),
}
#: Sentences with their spans, and such without, that taggers must get right.
BAD_CASES = (
    ("阿明加入星澜智算研究院", "0:2:PER,4:11:ORG"), ("你还小明天再说", "-"), ("长春市长春节前发表讲话", "0:2:LOC"), ("团队前往云海新区开展调研", "4:8:LOC"), ("海州市人民医院发布公告", "0:7:ORG"),
    ("研究生命起源", "-"), ("高昂的成本需要控制", "-"), ("田间管理需要加强", "-"), ("王小明在东湖区工作", "0:3:PER,4:7:LOC"), ("小王明天参加会议", "0:2:PER"),
    ("雷锋精神代代相传", "0:2:PER"), ("他从日本东京返回", "2:4:LOC,4:6:LOC"), ("上海证券交易所发布公告", "0:7:ORG"), ("普通用户今天提交申请", "-"), ("全国正在开展相关工作", "-"),
    ("文艺工作者参加座谈会", "-"), ("我们要盘活农村闲置资产", "-"), ("贫困山区需要改善交通", "-"), ("一些偏远地区仍有降雪", "-"), ("警方联手摧毁跨国诈骗集团", "-"),
    ("我国倡议成立的基础设施投资银行正在运营", "-"), ("两国国旗迎风飘扬", "-"), ("巴基斯坦拘捕大学袭击案嫌疑人", "-"), ("青岛崂山区的这个实验室完成测试", "-"), ("各战区授予军旗", "-"),
    ("成立了新的工作组", "-"), ("熊猫正在吃竹子", "-"), ("伊军正在开展行动", "-"),
)
