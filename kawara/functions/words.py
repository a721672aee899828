"""Word lists. All values here are fixed: results depend on each of them and, where said, on their order."""

PREFS = ["東京都", "神奈川県", "千葉県", "埼玉県", "愛知県", "大阪府", "京都府"]

SOURCE_TYPES = ["号外NET", "経済新聞", "独立系ブログ", "つうしん系", "ku2shin系"]

#: Words that aren't a shop's name.
NAME_REJECTS = [
    "オープン", "OPEN", "開店", "新店", "紹介", "情報",
]

#: Endings that aren't a station's.
STATION_REJECTS = [
    "病院駅", "郵便駅",
]

#: Words of which the headline of an opening has one.
TITLE_OPENINGS = [
    "オープン", "OPEN", "開店", "開業", "新規オープン", "新店", "グランドオープン", "New Open", "NEW OPEN", "移転", "リニューアル",
]

#: Words that no headline of an opening has.
TITLE_REJECTS = [
    "補助金", "助成金", "給付金", "支援金", "奨励金", "報奨金", "キャンペーン", "抽選", "プレゼント", "当選", "応募", "募集", "公募", "採用情報", "求人",
    "説明会", "セミナー", "講座", "講習", "ワークショップ", "イベント", "まつり", "祭り", "催事", "フェス", "中止", "終了", "締切", "締め切り",
    "期間限定終了", "リフォーム", "議会", "選挙", "行政", "条例", "法改正", "工事", "通行止め", "通行止", "規制", "注意", "警告", "被害", "ランキング",
    "まとめ", "特集", "インタビュー", "クイズ", "ランクイン", "第1位", "第一位", "TOP10", "ベスト", "不審者", "防犯", "犯罪", "詐欺", "事件", "事故",
    "火災", "救急", "マンション", "物件", "分譲", "賃貸", "住宅情報", "家賃", "売地", "売家", "中古住宅", "建売", "新築", "健康診断", "予防接種",
    "ワクチン", "がん検診", "閉鎖", "閉校", "休業", "営業時間変更", "臨時休業", "総選挙", "議員",
]

#: Words of businesses that serve no food.
NON_FOOD = [
    "美容室", "美容院", "ヘアサロン", "ヘアケア", "バーバー", "理容", "床屋", "ネイル", "ネイルサロン", "エステ", "エステサロン", "マッサージ", "リラクゼーション",
    "整体", "整骨", "接骨", "カイロプラクティック", "ホワイトニング", "歯科", "歯医者", "クリニック", "診療所", "医院", "耳鼻科", "眼科", "皮膚科", "薬局",
    "ドラッグストア", "ドラッグ", "メガネ", "眼鏡", "不動産", "リフォーム", "住宅展示", "モデルハウス", "工務店", "セレクトショップ", "アパレル", "古着",
    "ブティック", "衣料", "衣料品", "子ども服", "子供服", "こども服", "キッズウェア", "キッズ服", "ベビー服", "ベビーウェア", "マタニティウェア", "紳士服", "婦人服",
    "メンズ服", "レディース服", "ファッション", "ファッションブランド", "フラッグショップ", "旗艦店", "洋服店", "服飾", "アクセサリー", "ジュエリー", "時計店", "靴店",
    "シューズ", "バッグ", "鞄", "書店", "本屋", "古本", "100円ショップ", "100均", "ダイソー", "セリア", "キャンドゥ", "雑貨店", "生活雑貨",
    "インテリアショップ", "家具店", "フィットネス", "ジム", "ヨガスタジオ", "ピラティス", "学習塾", "塾", "英会話", "スクール", "教室", "予備校", "保育園",
    "幼稚園", "買取", "質屋", "リサイクルショップ", "パチンコ", "スロット", "ゲームセンター", "コインランドリー", "ペットショップ", "トリミング", "花屋",
    "フラワーショップ", "葬儀", "葬祭", "クリーニング店", "自動車販売", "カーディーラー", "中古車", "家電量販", "携帯ショップ",
]

#: Words of which a food article has at least one.
FOOD = [
    "飲食店", "飲食", "食堂", "食事", "レストラン", "ランチ", "ディナー", "モーニング", "ラーメン", "中華そば", "つけ麺", "そば", "蕎麦", "うどん", "料理",
    "グルメ", "和食", "洋食", "中華", "和菓子", "洋菓子", "カフェ", "Cafe", "CAFE", "喫茶", "コーヒー", "珈琲", "パン", "ベーカリー",
    "ブーランジェリー", "居酒屋", "酒場", "バル", "ビストロ", "ダイニング", "焼肉", "焼鳥", "焼き鳥", "串焼き", "鉄板", "ホルモン", "寿司", "鮨", "すし",
    "イタリアン", "フレンチ", "韓国料理", "タイ料理", "ベトナム料理", "インド料理", "カレー", "スイーツ", "ケーキ", "パティスリー", "ジェラート", "クレープ",
    "アイス", "かき氷", "タピオカ", "テイクアウト", "フードコート", "キッチン", "厨房", "お弁当", "弁当", "餃子", "たこ焼き", "お好み焼き", "鉄板焼", "肉",
    "魚介", "海鮮", "サンドイッチ", "バーガー", "ワイン", "日本酒", "クラフトビール", "ハイボール", "定食",
]

#: Names of national chains.
CHAINS = [
    "スターバックス", "Starbucks", "STARBUCKS", "スタバ", "ドトール", "ベローチェ", "エクセルシオール", "タリーズ", "Tully", "サンマルクカフェ",
    "コメダ珈琲", "プロント", "ブルーボトル", "星乃珈琲", "マクドナルド", "McDonald", "マック", "ミスタードーナツ", "ミスド", "ケンタッキー", "KFC",
    "モスバーガー", "バーガーキング", "フレッシュネスバーガー", "ロッテリア", "サブウェイ", "吉野家", "松屋", "すき家", "なか卯", "大戸屋", "やよい軒", "ねぎし",
    "ガスト", "ジョナサン", "サイゼリヤ", "デニーズ", "ロイヤルホスト", "ココス", "ビッグボーイ", "バーミヤン", "夢庵", "丸亀製麺", "はなまるうどん", "一蘭",
    "一風堂", "天下一品", "幸楽苑", "日高屋", "リンガーハット", "ラーメン横綱", "スガキヤ", "スシロー", "くら寿司", "はま寿司", "かっぱ寿司", "銚子丸", "牛角",
    "焼肉キング", "安楽亭", "焼肉ライク", "ドミノ・ピザ", "ドミノピザ", "ピザハット", "ピザーラ", "カプリチョーザ", "五右衛門", "鎌倉パスタ", "CoCo壱番屋",
    "ココイチ", "日乃屋カレー", "鳥貴族", "串カツ田中", "ワタミ", "魚民", "白木屋", "和民", "磯丸水産", "はなの舞", "サンジェルマン", "ヴィ・ド・フランス",
    "リトルマーメイド", "31アイスクリーム", "サーティワン", "Baskin Robbins", "ハーゲンダッツ", "コールド・ストーン", "ブロンコビリー", "シャトレーゼ", "不二家",
    "セブン-イレブン", "セブンイレブン", "ローソン", "ファミリーマート", "ミニストップ", "デイリーヤマザキ", "無印良品", "ユニクロ", "GU", "しまむら",
]

#: Genres and their words; of equal scores the earlier genre wins.
GENRES = {
    "焼鳥": ["焼鳥", "焼き鳥", "やきとり", "ヤキトリ", "炭火焼鳥", "炭火焼き鳥", "鳥料理", "とり料理"],
    "焼肉": ["焼肉", "焼き肉", "ヤキニク", "ホルモン", "ホルモン焼"],
    "寿司": ["寿司", "鮨", "回転寿司", "にぎり寿司", "寿し"],
    "ラーメン": ["ラーメン", "らーめん", "中華そば", "つけ麺", "担々麺", "まぜそば"],
    "うどん": ["うどん", "讃岐うどん"],
    "そば": ["蕎麦", "十割そば", "手打ちそば"],
    "パスタ": ["パスタ", "スパゲッティ", "スパゲティ", "ナポリタン", "ペペロンチーノ"],
    "ピザ": ["ピザ", "ピッツァ", "Pizza", "Pizzeria"],
    "イタリアン": ["イタリアン", "Italian", "Osteria", "オステリア", "トラットリア", "Ristorante"],
    "フレンチ": ["フレンチ", "French", "ビストロ", "Bistro", "Brasserie"],
    "中華": ["中華料理", "餃子", "四川料理", "台湾料理", "北京料理", "広東料理", "上海料理", "麻婆"],
    "韓国料理": ["韓国料理", "サムギョプサル", "チーズタッカルビ", "韓国チキン"],
    "タイ料理": ["タイ料理", "ガパオ", "トムヤム"],
    "ベトナム料理": ["ベトナム料理", "生春巻"],
    "インド料理": ["インド料理", "インドカレー", "ビリヤニ"],
    "ケバブ": ["ケバブ", "ケバブサンド", "ドネルケバブ", "シシケバブ", "シシカバブ", "トルコ料理", "トルコ料理店"],
    "中東料理": ["中東料理", "アラブ料理", "ハラルフード", "ハラールフード"],
    "カレー": ["カレーライス", "カレー専門", "スープカレー", "ルーカレー", "カレー店", "インドカレー"],
    "居酒屋": ["居酒屋", "酒場", "ダイニングバー", "バル", "もつ焼き", "串揚げ", "串カツ"],
    "バー": ["BAR", "ダイニングバー", "ワインバー", "ウイスキー", "カクテル", "オーセンティックバー"],
    "カフェ": ["カフェ", "Cafe", "CAFE", "café", "喫茶店", "珈琲店", "コーヒースタンド", "コーヒー専門"],
    "ベーカリー": ["ベーカリー", "Boulangerie", "ブーランジェリー", "パン屋", "食パン専門", "高級食パン", "デニッシュ専門"],
    "スイーツ": ["スイーツ", "ケーキ屋", "パティスリー", "ジェラート", "クレープ", "ドーナツ", "タピオカ", "かき氷", "マカロン", "アイスクリーム"],
    "和菓子": ["和菓子", "大福", "団子", "最中", "どら焼き"],
    "定食": ["定食屋", "食堂", "おふくろの味"],
    "鉄板焼": ["鉄板焼", "お好み焼", "もんじゃ", "たこ焼"],
    "うなぎ": ["うなぎ", "鰻"],
    "天ぷら": ["天ぷら専門", "天麩羅"],
    "餃子": ["餃子専門", "焼き餃子専門", "餃子専門店"],
    "海鮮": ["海鮮料理", "魚介料理", "魚料理専門"],
}

#: The genre shown where none is known, and the colours of the genres that have one of their own.
OTHER_GENRE = "その他"
OTHER_COLOUR = "#6b7280"
GENRE_COLOURS = {
    "居酒屋": "#c4554d",
    "ラーメン": "#d97706",
    "カフェ": "#7c6f64",
    "ベーカリー": "#b87333",
    "焼肉": "#8b1e1e",
    "カレー": "#c97b2a",
    "タイ料理": "#6a7f3a",
    "寿司": "#143d5c",
    "スイーツ": "#c2528b",
    "イタリアン": "#2d5f3f",
    "中華": "#9b2226",
    "フレンチ": "#3a5a82",
    "沖縄料理": "#c95d4a",
    "和菓子": "#6b4226",
    "そば": "#4a5c3a",
}

#: Parts of shop names that an audit reports.
SUSPICIOUS = [
    "マンション", "不審者", "ランキング", "防犯", "事件", "物件", "分譲", "賃貸", "事故", "クイズ", "補助金", "セミナー", "イベント", "キャンペーン",
    "ランクイン",
]

#: Parts of shop names that the first clean-up deletes.
NOISE = [
    "マンション", "不審者", "ランキング", "防犯", "事件", "物件", "分譲", "賃貸", "事故", "クイズ", "ランクイン",
]

#: Parts of shop names that the second clean-up deletes.
MORE_NOISE = [
    "補助金", "助成金", "給付金", "不審者", "防犯", "講座", "セミナー", "ワークショップ", "受付終了", "募集中", "応募", "お知らせ", "マネープラン",
    "マネ-プラン", "省エネ", "補助", "マンション", "ランキング", "クイズ", "事件", "事故", "物件", "分譲", "賃貸", "閉店", "閉業", "改装", "リニューアル",
    "移転", "イベント", "祭り", "まつり", "キャンペーン", "中止", "記事タイトル", "について", "終了", "締切", "工事", "議会",
]
