"""Glyphs of the legacy eight-bit Bengali font and the spellings that go with them: fixed values, one pair a line.

A table with over 200 pairs is kept in parts by what the glyphs are.
"""

#: Letters by code; fixed values.
LETTERS = {
    'A': 'অ',
    'B': 'ই',
    'C': 'ঈ',
    'D': 'উ',
    'E': 'ঊ',
    'F': 'ঋ',
    'G': 'এ',
    'H': 'ঐ',
    'I': 'ও',
    'J': 'ঔ',
    'K': 'ক',
    'L': 'খ',
    'M': 'গ',
    'N': 'ঘ',
    'O': 'ঙ',
    'P': 'চ',
    'Q': 'ছ',
    'R': 'জ',
    'S': 'ঝ',
    'T': 'ঞ',
    'U': 'ট',
    'V': 'ঠ',
    'W': 'ড',
    'X': 'ঢ',
    'Y': 'ণ',
    'Z': 'ত',
    '_': 'থ',
    '`': 'দ',
    'a': 'ধ',
    'b': 'ন',
    'c': 'প',
    'd': 'ফ',
    'e': 'ব',
    'f': 'ভ',
    'g': 'ম',
    'h': 'য',
    'i': 'র',
    'j': 'ল',
    'k': 'শ',
    'l': 'ষ',
    'm': 'স',
    'n': 'হ',
    'o': 'ড়',
    'p': 'ঢ়',
    'q': 'য়',
    'r': 'ৎ',
    's': 'ং',
    't': 'ঃ',
    'u': 'ঁ',
}

#: Vowel signs, punctuation and marks by code; fixed values.
SIGNS = {
    '&': '্',
    'v': 'া',
    'w': 'ি',
    'x': 'ী',
    'y': 'ু',
    'z': 'ু',
    '|': '।',
    '~': 'ূ',
    'Ò': '"',
    'Ó': '"',
    'Ô': "'",
    'Õ': "'",
    'Š': 'ৗ',
    'ƒ': 'ূ',
    'ˆ': 'ৈ',
    '–': 'ু',
    '‚': 'ূ',
    '“': 'ু',
    '„': 'ৃ',
    '†': 'ে',
    '‡': 'ে',
    '…': 'ৃ',
    '‰': 'ৈ',
}

#: First halves of conjuncts by code; fixed values.
HALVES = {
    '¤': 'ম্',
    '®': 'ষ্',
    '¯': 'স্',
    'š': 'ন্',
    '˜': 'দ্',
    '”': 'চ্',
    '•': 'ঙ্',
    '›': 'ন্',
    '™': 'দ্',
}

#: Letters set below or behind others by code; fixed values.
BELOW = {
    '^': '্ব',
    '¡': '্ব',
    '¢': '্ভ',
    '£': '্ভ্র',
    '¥': '্ম',
    '¦': '্ব',
    '§': '্ম',
    '¨': '্য',
    'ª': '্র',
    '«': '্র',
    '¬': '্ল',
    '\xad': '্ল',
    '¿': '্ত্র',
    'Ö': '্র',
    'è': '্ন',
    'ø': '্ল',
    'ú': '্প',
    'Œ': '্ক্র',
    'œ': '্ন',
    'Ÿ': '্ব',
    '—': '্ত',
    '‘': '্তু',
    '’': '্থ',
    '‹': '্ক',
}

#: Whole conjuncts by code; fixed values.
WHOLE = {
    '°': 'ক্ক',
    '±': 'ক্ট',
    '²': 'ক্ষ্ণ',
    '³': 'ক্ত',
    '´': 'ক্ম',
    'µ': 'ক্র',
    '¶': 'ক্ষ',
    '·': 'ক্স',
    '¸': 'গু',
    '¹': 'জ্ঞ',
    'º': 'গ্দ',
    '»': 'গ্ধ',
    '¼': 'ঙ্ক',
    '½': 'ঙ্গ',
    '¾': 'জ্জ',
    'À': 'জ্ঝ',
    'Á': 'জ্ঞ',
    'Â': 'ঞ্চ',
    'Ã': 'ঞ্ছ',
    'Ä': 'ঞ্জ',
    'Å': 'ঞ্ঝ',
    'Æ': 'ট্ট',
    'Ç': 'ড্ড',
    'È': 'ণ্ট',
    'É': 'ণ্ঠ',
    'Ê': 'ণ্ড',
    'Ë': 'ত্ত',
    'Ì': 'ত্থ',
    'Í': 'ত্ম',
    'Î': 'ত্র',
    'Ï': 'দ্দ',
    'Ð': 'ণ্ড',
    'Ñ': 'ণ্ঢ',
    '×': 'দ্ধ',
    'Ø': 'দ্ব',
    'Ù': 'দ্ম',
    'Ú': 'ন্ঠ',
    'Û': 'ন্ড',
    'Ü': 'ন্ধ',
    'Ý': 'ন্স',
    'Þ': 'প্ট',
    'ß': 'প্ত',
    'à': 'প্প',
    'á': 'প্স',
    'â': 'ব্জ',
    'ã': 'ব্দ',
    'ä': 'ব্ধ',
    'å': 'ভ্র',
    'æ': 'ম্ন',
    'ç': 'ম্ফ',
    'é': 'ল্ক',
    'ê': 'ল্গ',
    'ë': 'ল্ট',
    'ì': 'ল্ড',
    'í': 'ল্প',
    'î': 'ল্ফ',
    'ï': 'শু',
    'ð': 'শ্চ',
    'ñ': 'শ্ছ',
    'ò': 'ষ্ণ',
    'ó': 'ষ্ট',
    'ô': 'ষ্ঠ',
    'õ': 'ষ্ফ',
    'ö': 'স্খ',
    '÷': 'স্ট',
    'ù': 'স্ফ',
    'û': 'হু',
    'ü': 'হৃ',
    'ý': 'হ্ন',
    'þ': 'হ্ম',
    'ÿ': 'ক্ষ',
}

#: Runs of glyphs that mean something else than their glyphs in turn; fixed values.
RUNS = {
    'Av': 'আ',
    '„„': 'ৃ',
    '¯Í': 'স্ত',
    '¯V': 'ষ্ঠ',
    'šÍ': 'ন্ত',
    'iæ': 'রু',
    '¯Íæ': 'স্তু',
    'kÖæ': 'শ্রু',
    '`ªæ': 'দ্রু',
    'Kwg©': 'কর্মী',
    'Kwgevb': 'কর্মবীর',
}

#: Words with a spelling of their own; a value in the font is read on; fixed values.
ALIASES = {
    '†M©‡i': 'M‡Z©i',
    'fvል': 'fv‡jv',
    'PvL': '†PvL',
    'QvU': '†QvU',
    'Nvi': 'ঘর',
    'Pv‡Li': '†Pv‡Li',
    's‡Ni': 'i‡Oi',
    'kZ©i': 'kZ©‡i',
    'cÖKíi': 'cÖK‡íi',
    'fvjevmv': 'fv‡jvevmv',
    '‡necvZ': '†ndvRZ',
    '†necvZ': '†ndvRZ',
    'Mvieg': '†MŠie',
    'gbvgynKi': 'g‡bvgy»Ki',
    'BwZnvmeav': 'BwZnvmwe`',
    'bZzgvb': 'bxwZevb',
    'RvMiyK': 'RvMÖZ',
    'Acic': 'Ac~e©',
    'AvkMÖn': 'AvMÖn',
    'cÖ‡iivYvq': '†cÖiYvq',
    'Abwb¨': 'Abb¨',
    'weceøx': 'wecøex',
    'Mewjô': 'ewjô',
    'AwPj': 'APj',
    'axie': 'axi',
    'Mfxii': 'Mfxi',
    'kxeª': 'Zxeª',
    'mÜx': 'mwÜ',
    'gÎx': '‰gÎx',
    'mfev': 'mfv',
    'myevea': 'myweav',
    'fimev': 'fimv',
    'cÖZ¨vq': 'cÖZ¨q',
    '`›`': 'Ø›Ø',
    'D‡bœl': 'D‡b¥l',
    'wbicÿ': 'wbi‡cÿ',
    'e‡bi': 'বনের',
    'AvB‡bi': 'আইনের',
    'Av‡e`‡bi': 'আবেদনের',
    'Kh©': 'Kvh©',
    'ah©': 'avh©',
    'Mel©': 'Me©',
    'fe©': 'Le©',
    'ea©K¨': 'eva©K¨',
    'Mwb©k': 'Mvwb©k',
    'wbfe©j': 'wbf©i',
    'wbfe©jZv': 'wbf©iZv',
    'wbi©_K': 'wbi_©K',
    'Drmwe©Z': 'DrmwM©Z',
    'Z©K': 'ZK©',
    'mZ©K': 'mZK©',
    'mZ©KZv': 'mZK©Zv',
    'c`k©b': 'cÖ`k©b',
    'msMl©': 'msNl©',
    'mv‡_ ': 'সাথে',
}

#: Conjuncts that have a glyph or a run, by letter; fixed values.
CONJUNCTS = {
    'ক্ক': '°',
    'ক্ট': '±',
    'ক্ত': '³',
    'ক্ম': '´',
    'ক্র': 'µ',
    'ক্ষ': '¶',
    'ক্ষ্ণ': '²',
    'ক্স': '·',
    'গ্দ': 'º',
    'গ্ধ': '»',
    'গ্র': 'MÖ',
    'ঙ্ক': '¼',
    'ঙ্গ': '½',
    'চ্চ': '”P',
    'চ্ছ': '”Q',
    'জ্জ': '¾',
    'জ্ঝ': 'À',
    'জ্ঞ': '¹',
    'ঞ্চ': 'Â',
    'ঞ্ছ': 'Ã',
    'ঞ্জ': 'Ä',
    'ঞ্ঝ': 'Å',
    'ট্ট': 'Æ',
    'ড্ড': 'Ç',
    'ণ্ট': 'È',
    'ণ্ঠ': 'É',
    'ণ্ড': 'Ê',
    'ণ্ণ': 'Y&Y',
    'ত্ত': 'Ë',
    'ত্থ': 'Ì',
    'ত্ম': 'Í',
    'ত্র': 'Î',
    'দ্দ': 'Ï',
    'দ্ধ': '×',
    'দ্ব': 'Ø',
    'দ্ম': 'Ù',
    'ন্ত': 'šÍ',
    'ন্তু': 'š‘',
    'ন্ত্র': 'š¿',
    'ন্থ': 'š’',
    'ন্দ': '›`',
    'ন্ধ': 'Ü',
    'ন্ন': 'bœ',
    'ন্ম': 'b¥',
    'ন্স': 'Ý',
    'প্ট': 'Þ',
    'প্ত': 'ß',
    'প্ন': 'cœ',
    'প্প': 'à',
    'প্র': 'cÖ',
    'প্ল': 'cø',
    'প্স': 'á',
    'ব্জ': 'â',
    'ব্দ': 'ã',
    'ব্ধ': 'ä',
    'ব্ব': 'e&e',
    'ভ্র': 'å',
    'ম্ন': 'æ',
    'ম্ফ': 'ç',
    'ম্ব': '¤^',
    'ম্ভ': '¤¢',
    'ম্ম': '¤§',
    'ল্ক': 'é',
    'ল্গ': 'ê',
    'ল্ট': 'ë',
    'ল্ড': 'ì',
    'ল্প': 'í',
    'ল্ফ': 'î',
    'ল্ল': 'j&j',
    'শু': 'ï',
    'শ্চ': 'ð',
    'শ্ছ': 'ñ',
    'শ্ব': 'k¦',
    'শ্ম': 'k¥',
    'শ্র': 'kª',
    'শ্ল': 'kø',
    'ষ্ট': 'ó',
    'ষ্ঠ': 'ô',
    'ষ্ণ': 'ò',
    'ষ্ফ': 'õ',
    'স্ক': '¯‹',
    'স্খ': 'ö',
    'স্ট': '÷',
    'স্ত': '¯Í',
    'স্ত্র': '¯¿',
    'স্থ': '¯’',
    'স্ন': '¯œ',
    'স্প': '¯ú',
    'স্প্ল': '¯cø',
    'স্ফ': 'ù',
    'স্ব': '¯^',
    'হু': 'û',
    'হৃ': 'ü',
    'হ্ন': 'ý',
    'হ্ম': 'þ',
    'হ্ল': 'n¬',
}

#: Spellings mended before reading, in this order; fixed values.
TYPING = [
    ('yy', 'y'),
    ('vv', 'v'),
    ('y&', 'y'),
    ('„&', '„'),
    ('‡u', 'u‡'),
    ('wu', 'uw'),
    (' ,', ','),
    (' |', '|'),
    ('\\', ''),
]
