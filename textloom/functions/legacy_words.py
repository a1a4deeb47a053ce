"""Vocabularies of the legacy encoding's tests, both replaceable by parameters: English words that stay, and common Bengali words."""

#: English words by kind.
_KINDS = {
    "articles, pronouns, particles": "an the you he she it we they me him her us them my your his its our their who whom whose which what that this these those there here not no yes nor neither either both all any some each every other another such same own none",
    "prepositions, conjunctions": "of in on at to by for from with without into onto upon over under above below between among through during before after since until against about across along around behind beside beyond near off out up down and or but if then else than as so because while although though unless whether per via",
    "auxiliaries": "am is are was were be been being do does did done has have had will would shall should can could may might must let",
    "verbs": "go goes went come came get got give gave take took make made see saw say said know knew find found use used call called look write wrote read keep kept put set show tell told ask think work pay paid hold held meet run",
    "adverbs, numbers": "now when where why how again also even ever just more most much many very too only still well often once first second third last next one two three four five six seven eight nine ten hundred thousand new old long short high low good full same like way",
    "time": "day days week month year years date time today january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday",
    "office and law": "act acts bank bill board book books branch case code company copy court draft file form fund head issue item judge law laws legal ltd list loan mail memo name notice number office order page paper part people person post public rate record report right rule rules section sign staff state status sub suit sum table tax term title total trade unit value volume vote word",
    "network": "com email git html http https net org phone site url web www",
}
ENGLISH = frozenset(w for line in _KINDS.values() for w in line.split())

#: Common Bengali words; written in the font they tell it where every glyph is ASCII.
COMMON = (
    "আমি তুমি সে আমার তোমার তাহার আমরা তারা কথা কাল আজ এই খাতা কলম পানি জল আকাশ বাতাস নদী সাগর পাহাড় বন ফল ফুল গাছ পাখি মাছ মাথা হাত পা চোখ নাক কান মুখ গলা বুক সময় দিন রাত সকাল বিকাল সন্ধ্যা "
    "বছর মাস ভাল খারাপ সরকার পরিচালক চিত্র মানুষ সমাজ পৃথিবী দেশ গ্রাম শহর ঘর বাড়ি নাম কাজ বাংলা ভাষা যুক্ত"
).split()
