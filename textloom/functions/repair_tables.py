"""Spellings that broken fonts leave behind, and what they stand for, in the order in which they are mended."""

#: words parted by table rules; fixed values.
SPLIT = [
    (r"জলু\s*\|\s*াই", "জুলাই"),
    (r"জলু\s*াই", "জুলাই"),
    (r"খলু\s*\|\s*\|\s*না", "খুলনা"),
    (r"খলু\s*\|\s*না", "খুলনা"),
]

#: patterns of lost ligatures; fixed values.
LIGATURES = [
    (r"উপ-মহাব[\x00\s]*বস্থাপক", "উপ-মহাব্যবস্থাপক"),
    (r"সহকারী\s*মহাব[\x00\s]*বস্থাপক", "সহকারী মহাব্যবস্থাপক"),
    (r"মহাব[\x00\s]*বস্থাপক", "মহাব্যবস্থাপক"),
    (r"ব[\x00\s]*বস্থাপক", "ব্যবস্থাপক"),
    (r"অনলাইন\s+ব[\x00\s]*াংিকং", "অনলাইন ব্যাংকিং"),
    (r"ব[\x00\s]*াংিকং", "ব্যাংকিং"),
    (r"ব[\x00\s]*াংক", "ব্যাংক"),
    (r"িডপাট[\x00\s]*েমেন্টের", "ডিপার্টমেন্টের"),
    (r"িডপাট[\x00\s]*েমেন্টর", "ডিপার্টমেন্টের"),
    (r"িডপাট[\x00\s]*েমেন্ট", "ডিপার্টমেন্টের"),
    (r"িডপাট[\x00\s]*েমন্ট", "ডিপার্টমেন্ট"),
    (r"ডিপাট[\x00\s]*েমন্ট", "ডিপার্টমেন্ট"),
    (r"পাট[\x00\s]*েমন্ট", "পার্টমেন্ট"),
    (r"[\x00\s]*নিমি[\x00\s]*ক", "নৈমিত্তিক"),
    (r"ছু[\x00\s]*টর", "ছুটির"),
    (r"ছু[\x00\s]*টেত", "ছুটিতে"),
    (r"ছু[\x00\s]*টে", "ছুটিতে"),
    (r"(?<![\u0980-\u09FF])ছু[\x00\s]*ট(?![\u0980-\u09FF])", "ছুটি"),
    (r"প্রাপ্তব[\x00\s]+[\x00\s]*ভাগকৃত", "প্রাপ্তব্য ভোগকৃত"),
    (r"প্রাপ্তব\x00", "প্রাপ্তব্য"),
    (r"\x00ভাগকৃত", "ভোগকৃত"),
    (r"কাযা[\x00\s]*লয়", "কার্যালয়"),
    (r"কাযা[\x00\s]*ল", "কার্যাল"),
    (r"কমস্থ[\x00\s]*ল", "কর্মস্থল"),
    (r"কমস্থ[\x00\s]*", "কর্মস্থল "),
    (r"ত[\x00\s]*ােগর", "ত্যাগের"),
    (r"ত[\x00\s]*ভােগ", "ত্যাগে"),
    (r"ত[\x00\s]*ভাগ", "ত্যাগ"),
    (r"(?<![\u0980-\u09FF])জন[\x00\s]*(?![\u0980-\u09FF])", "জন্য"),
    (r"জন\x00", "জন্য"),
    (r"স[\x00\s]*ানপবূ[\s]*ক(?=[\x00\s]|$)", "সম্মানপূর্বক"),
    (r"স[\x00\s]*ানপূব্[\s]*ক(?=[\x00\s]|$)", "সম্মানপূর্বক"),
    (r"(?<![\u0980-\u09FF])য(?=[,\s])", "যে"),
    (r"ব[\x00\s]*িক্তগত", "ব্যক্তিগত"),
    (r"জর[\x00\s]*ির", "জরুরি"),
    (r"পযন্ত[\x00\s]*", "পর্যন্ত"),
    (r"অিফসার-আই[\x00\s]*ট(?![\u0980-\u09FF])", "অফিসার-আইটি"),
    (r"আই[\x00\s]*ট(?![\u0980-\u09FF])", "আইটি"),
    (r"উে[\x00\s]*খ[\x00\s]*", "উল্লেখ্য"),
    (r"ম[\x00\s]*রু\s*পবূ[\s]*ক", "মঞ্জুরপূর্বক"),
    (r"ম[\x00\s]*রু[\s]*ীর", "মঞ্জুরীর"),
    (r"ম[\x00\s]*রু", "মঞ্জুর"),
    (r"[\x00\s]*মাবাইল", "মোবাইল"),
    (r"নিথ\s*নং", "নথি নং"),
    (r"[\x00\s]*সল\s*ইনচাজ[\x00\s]*", "সেল ইনচার্জ"),
    (r"ইনচাজ[\x00\s]*", "ইনচার্জ"),
    (r"এিজএম", "এজিএম"),
    (r"িডিজএম", "ডিজিএম"),
    (r"\x00", ""),
]

#: words in the order of glyphs; fixed values.
VOCABULARY = [
    (r"মেহাদয়", "মহোদয়"),
    (r"প্রেয়াজেন", "প্রয়োজনে"),
    (r"প্রেয়াজন", "প্রয়োজন"),
    (r"অনমুিতসহ", "অনুমতিসহ"),
    (r"অনমু\s*িতসহ", "অনুমতিসহ"),
    (r"অনকুূেল", "অনুকূলে"),
    (r"অনকু\s*ূ\s*েল", "অনুকূলে"),
    (r"অবিশষ্ট", "অবশিষ্ট"),
    (r"সপুািরশ", "সুপারিশ"),
    (r"সপু\s*ািরশ", "সুপারিশ"),
    (r"হেলা", "হলো"),
    (r"বািধত", "বাধিত"),
    (r"পািরবািরক", "পারিবারিক"),
    (r"িহেসেব", "হিসেবে"),
    (r"িহসেব", "হিসেবে"),
    (r"অিতিরক্ত", "অতিরিক্ত"),
    (r"িপএলিস", "পিএলসি"),
    (r"িবেশষ", "বিশেষ"),
    (r"আেবদন", "আবেদন"),
    (r"িনেবদন", "নিবেদন"),
    (r"িবনীত", "বিনীত"),
    (r"িববরণ", "বিবরণ"),
    (r"িতন", "তিন"),
    (r"িদেনর", "দিনের"),
    (r"দািয়ত্ব", "দায়িত্ব"),
    (r"দািয়েত্বর", "দায়িত্বের"),
    (r"আিরফু ল", "আরিফুল"),
    (r"িসিনয়র", "সিনিয়র"),
    (r"অিফসার", "অফিসার"),
    (r"তািরখ", "তারিখ"),
    (r"সােলর", "সালের"),
    (r"করেবন", "করবেন"),
    (r"করিছ", "করছি"),
    (r"যথািবিহত", "যথাবিহিত"),
    (r"সমীেপ", "সমীপে"),
    (r"সমীেপঃ", "সমীপেঃ"),
    (r"িবষয়ঃ", "বিষয়ঃ"),
    (r"আিম", "আমি"),
    (r"িনজ", "নিজ"),
    (r"িবশ্বস্ত", "বিশ্বস্ত"),
    (r"আইিডঃ", "আইডিঃ"),
]

#: gazette spellings before vowel signs are moved; fixed values.
GLYPH_ORDER = [
    ("পৰ্", "প্র"),
    ("ন্তৰ্", "ন্ত্র"),
    ("বৰ্", "ব্র"),
    ("তৰ্", "ত্র"),
    ("কৰ্", "ক্র"),
    ("ভৰ্", "ভ্র"),
    ("শৰ্", "শ্র"),
    ("দৰ্", "দ্র"),
    ("পৰ্বতৰ্ন", "প্রবর্তন"),
    ("পৰ্য়োগ", "প্রয়োগ"),
    ("পৰ্দত্ত", "প্রদত্ত"),
    ("পৰ্তিষ্ঠান", "প্রতিষ্ঠান"),
    ("পৰ্দান", "প্রদান"),
    ("পৗষ", "পৌষ"),
    ("কাযৰ্কর", "কার্যকর"),
    ("শতৰ্", "শর্ত"),
    ("উিল্লিখত", "উল্লিখিত"),
    ("বতেন", "বেতন"),
    ("নিধৰ্ারণ", "নির্ধারণ"),
    ("নিধৰ্ারিত", "নির্ধারিত"),
    ("নিম্নবণিৰ্ত", "নিম্নবর্ণিত"),
    ("সব্ শাসিত", "স্বশাসিত"),
    ("আসব্ খ", "স্বশাসিত"),
    ("গণয্", "গণ্য"),
    ("খিৰ্স্টাব্দ", "খ্রিস্টাব্দ"),
    ("পৰ্কাশ", "প্রকাশ"),
    ("পৰ্শাসনিক", "প্রশাসনিক"),
    ("পৰ্ধান", "প্রধান"),
    ("মন্র্তণালয়", "মন্ত্রণালয়"),
    ("গণপ্রজাতন্র্তী", "গণপ্রজাতন্ত্রী"),
    ("প্রবত্রন", "প্রবর্তন"),
    ("শত্ৰ", "শর্ত"),
    ("কায্রকর", "কার্যকর"),
    ("নিধ্রারণ", "নির্ধারণ"),
    ("নিধ্রারিত", "নির্ধারিত"),
    ("িনধ্রািরত", "নির্ধারিত"),
    ("ডিসেমব্র", "ডিসেম্বর"),
    ("র্খস্টিাব্দ", "খ্রিস্টাব্দ"),
    ("রার্ষ্টায়ত্ত", "রাষ্ট্রায়ত্ত"),
    ("বয্াংক", "ব্যাংক"),
    ("বয্াখয্া", "ব্যাখ্যা"),
    ("অনয্ানয্", "অন্যান্য"),
    ("প্রাপয্", "প্রাপ্য"),
    ("উদ্দেশয্", "উদ্দেশ্য"),
    ("পৗরসভা", "পৌরসভা"),
    ("জলা পরিষদ", "জেলা পরিষদ"),
    ("ক্ষত্রে", "ক্ষেত্রে"),
    ("কত্রৃপক্ষ", "কর্তৃপক্ষ"),
    ("মহাঘ্রভাতা", "মহার্ঘভাতা"),
    ("আথ্রিক", "আর্থিক"),
    ("স্হানীয়", "স্থানীয়"),
    ("সমনব্য়", "সমন্বয়"),
    ("ৰ্", "র্"),
    ("ৰ", "র"),
]

#: gazette words after vowel signs were moved; fixed values.
WORDS = [
    ("তারখি", "তারিখ"),
    ("হসিাবে", "হিসাবে"),
    ("হইবনে", "হইবেন"),
    ("সময়রে", "সময়ের"),
    ("বকয়ো", "বকেয়া"),
    ("আদশে", "আদেশ"),
    ("জাররি", "জারির"),
    ("বতনে", "বেতনে"),
    ("জাতীয় বতেনস্কেল", "জাতীয় বেতনস্কেল"),
    ("ইতোমধেয্", "ইতোমধ্যে"),
    ("বতেনস্কেল", "বেতনস্কেল"),
    ("বতেন", "বেতন"),
    ("বতন", "বেতন"),
    ("েরিজস্টাডর্", "রেজিস্টার্ড"),
    ("রেজিস্টাডর্", "রেজিস্টার্ড"),
    ("বাংলােদশ", "বাংলাদেশ"),
    ("েগেজট", "গেজেট"),
    ("অিতিরক্ত", "অতিরিক্ত"),
    ("কতৃর্পক্ষ", "কর্তৃপক্ষ"),
    ("কতৃর্ক", "কর্তৃক"),
    ("প্রকািশত", "প্রকাশিত"),
    ("িডেসবরর", "ডিসেম্বর"),
    ("ডিসেবরর", "ডিসেম্বর"),
    ("িডেসমব্র", "ডিসেম্বর"),
    ("সব্শাসিত", "স্বশাসিত"),
    ("স্কল", "স্কেল"),
    ("গ্রড", "গ্রেড"),
    ("ইিব", "ইবি"),
    ("উল্লখিতি", "উল্লিখিত"),
    ("আেদশ", "আদেশ"),
    ("অথ্র", "অর্থ"),
    ("িবভাগ", "বিভাগ"),
    ("অনুিবভাগ", "অনুবিভাগ"),
    ("তািরখ", "তারিখ"),
    ("পৗষ", "পৌষ"),
    ("িখ্রস্টাব্দ", "খ্রিস্টাব্দ"),
    ("৩৭০-আ ইন/২০১৫", "৩৭০-আইন/২০১৫"),
    ("৩৭০-আইন", "৩৭০-আইন"),
    ("ডিসেমব্র", "ডিসেম্বর"),
    ("মংল্য ঃ", "মূল্য :"),
]
