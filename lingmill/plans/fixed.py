"""Fixed values for the SQL of the registered queries, written out: a slip in the tables of lingmill.functions shows as a difference."""

#: ordinal, name, code, three-letter code, other names (- for none), scripts.
LANGUAGES = """
0 afrikaans af afr - LATIN
1 albanian sq sqi - LATIN
2 azerbaijani az aze - LATIN
3 basque eu eus - LATIN
4 catalan ca cat - LATIN
5 croatian hr hrv - LATIN
6 czech cs ces - LATIN
7 danish da dan - LATIN
8 dutch nl nld - LATIN
9 english en eng - LATIN
10 esperanto eo epo - LATIN
11 estonian et est - LATIN
12 finnish fi fin - LATIN
13 french fr fra - LATIN
14 ganda lg lug - LATIN
15 german de deu - LATIN
16 hungarian hu hun - LATIN
17 icelandic is isl - LATIN
18 indonesian id ind - LATIN
19 italian it ita - LATIN
20 irish ga gle gaelic LATIN
21 latin la lat - LATIN
22 latvian lv lav - LATIN
23 lithuanian lt lit - LATIN
24 luxembourgish lb ltz - LATIN
25 malay ms msa malaysian LATIN
26 maori mi mri - LATIN
27 norwegian no nor bokmal,nb LATIN
28 nynorsk nn nno - LATIN
29 oromo om orm - LATIN
30 polish pl pol - LATIN
31 portuguese pt por - LATIN
32 romanian ro ron - LATIN
33 shona sn sna - LATIN
34 slovak sk slk - LATIN
35 slovenian sl slv slovene LATIN
36 somali so som - LATIN
37 sotho st sot - LATIN
38 spanish es spa - LATIN
39 swahili sw swa - LATIN
40 swedish sv swe - LATIN
41 tagalog tl tgl - LATIN
42 tsonga ts tso - LATIN
43 tswana tn tsn - LATIN
44 turkish tr tur - LATIN
45 vietnamese vi vie - LATIN
46 welsh cy cym - LATIN
47 xhosa xh xho - LATIN
48 yoruba yo yor - LATIN
49 zulu zu zul - LATIN
50 chinese_simplified zh-hans zho-hans chinese,zh,zh-cn,zh-hans-cn,zh-hans-sg HAN
51 chinese_traditional zh-hant zho-hant zh-hant-hk,zh-hk,zh-hant-tw,zh-tw HAN
52 japanese ja jpn jp HAN,JA_KANA
53 korean ko kor - HANGUL
54 arabic ar ara - ARABIC
55 pashto ps pus - ARABIC
56 persian fa fas farsi ARABIC
57 urdu ur urd - ARABIC
58 belarusian be bel - CYRILLIC
59 bulgarian bg bul - CYRILLIC
60 macedonian mk mkd - CYRILLIC
61 mongolian mn mon - CYRILLIC
62 russian ru rus - CYRILLIC
63 serbian sr srp - CYRILLIC
64 ukrainian uk ukr - CYRILLIC
65 amharic am amh - ETHIOPIC
66 tigrinya ti tig - ETHIOPIC
67 armenian hy hye - ARMENIAN
68 bengali bn ben - BENGALI
69 burmese my mya myanmar MYANMAR
70 georgian ka kat - GEORGIAN
71 greek el ell - GREEK
72 gujarati gu guj - GUJARATI
73 hebrew he heb - HEBREW
74 hindi hi hin - DEVANAGARI
75 kannada kn kan - KANNADA
76 khmer km khm - KHMER
77 lao lo lao - LAO
78 malayalam ml mal - MALAYALAM
79 punjabi pa pan - GURMUKHI
80 sinhala si sin - SINHALA
81 tamil ta tam - TAMIL
82 telugu te tel - TELUGU
83 thai th tha - THAI
"""

#: ordinal, script, weight of a character.
ALPHABETS = """
0 LATIN 1.0
1 HAN 3.0
2 JA_KANA 2.0
3 HANGUL 2.0
4 ARABIC 1.25
5 ARMENIAN 1.0
6 BENGALI 1.0
7 CYRILLIC 1.0
8 DEVANAGARI 1.0
9 ETHIOPIC 1.0
10 GEORGIAN 1.0
11 GREEK 1.0
12 GUJARATI 1.0
13 GURMUKHI 1.0
14 HEBREW 1.0
15 KANNADA 1.0
16 KHMER 1.0
17 LAO 1.0
18 MALAYALAM 1.0
19 MYANMAR 1.0
20 SINHALA 1.0
21 TAMIL 1.0
22 TELUGU 1.0
23 THAI 1.0
"""

#: group, its languages by code.
GROUPS = """
all af,am,ar,az,be,bg,bn,ca,cs,cy,da,de,el,en,eo,es,et,eu,fa,fi,fr,ga,gu,he,hi,hr,hu,hy,id,is,it,ja,ka,km,kn,ko,la,lb,lg,lo,lt,lv,mi,mk,ml,mn,ms,my,nl,nn,no,om,pa,pl,ps,pt,ro,ru,si,sk,sl,sn,so,sq,sr,st,sv,sw,ta,te,th,ti,tl,tn,tr,ts,uk,ur,vi,xh,yo,zh-hans,zh-hant,zu
cj ja,zh-hans,zh-hant
cjk ja,ko,zh-hans,zh-hant
efigs de,en,es,fr,it
efigsnp de,en,es,fr,it,nl,pt
nordic da,fi,no,sv
europe_west_common da,de,en,es,fi,fr,it,nl,no,pt,sv
europe_common be,bg,cs,da,de,en,es,et,fi,fr,hr,hu,it,lt,lv,mk,nl,no,pl,pt,ro,ru,sk,sl,sq,sr,sv,uk
europe_east_latin cs,et,hr,hu,lt,lv,pl,ro,sk,sl,sq
europe_latin ca,cs,cy,da,de,en,es,et,eu,fi,fr,ga,hr,hu,is,it,lb,lt,lv,nl,nn,no,pl,pt,ro,sk,sl,sq,sv,tr
europe_cyrillic be,bg,mk,ru,sr,uk
europe be,bg,ca,cs,cy,da,de,en,es,et,eu,fi,fr,ga,hr,hu,is,it,lb,lt,lv,mk,nl,nn,no,pl,pt,ro,ru,sk,sl,sq,sr,sv,tr,uk
latin_alphabet af,az,ca,cs,cy,da,de,en,eo,es,et,eu,fi,fr,ga,hr,hu,id,is,it,la,lb,lg,lt,lv,mi,ms,nl,nn,no,om,pl,pt,ro,sk,sl,sn,so,sq,st,sv,sw,tl,tn,tr,ts,vi,xh,yo,zu
cyrillic_alphabet be,bg,mk,mn,ru,sr,uk
arabic_alphabet ar,fa,ps,ur
unique_alphabet bn,el,gu,he,hi,hy,ka,km,kn,ko,lo,ml,my,pa,si,ta,te,th
"""

#: Letters with an accent or of another form, the plain letter of each at the same place; and letters that become several.
ACCENTED = "ａªᵃₐáàăắằẵẳâấầẫẩǎåǻäǟãȧąāảȁȃạặậḁᴀⱥɐɑɒｂḃḅḇʙƀɓƃꞵｃᶜćĉčċçḉᴄȼꞓɕↄｄďḋḑđḍḓḏðʤᴅɖɗｅᵉᴱéèĕêếềễểěëẽėȩḝęēḗḕẻȅȇẹệḛᴇɇǝəᵊɛɘɚɜɝɞɤｆḟƒⅎｇǵğĝǧġģḡᵹɡɢǥɠɣˠƣｈʰĥȟḧḣḩħḥḫẖʜƕɦʱɧｉⅰⁱᵢíìĭîǐïḯĩįīỉȉȋịḭıɪᴉɨᵻɩｊʲĵǰȷᴊʝɟʄｋḱǩķḳḵƙⱪꝃʞｌˡĺľļłḷḹḻŀʟƚⱡɫɬɭɮƛʎᵐᴹḿṁṃᴍɱｎⁿńǹňñṅņṇṋṉɴᵰɲƞꞑᶇɳŋᵑｏºᵒóòŏôốồỗổǒöȫőõȭȯøǿǫǭōṓṑỏȍȏơớờỡởợọộᴏɔᵓᴖᴗɵɷⱷｐṕṗᴘƥɸꝗĸｒʳŕřṙŗȓṛṝṟꝛʀɍɹᴚɺɻɼɽɾɿʁｓśṥŝšṧṡşṣșſꜱʂʃｔᵀťẗṫţṭțṱṯʨʦᴛŧƭʈȶʇｕᵘúùŭûǔůüǘǜǚǖűũųūṻủȕȗưứừữửựụṳṷṵʉɥɯɰʊｖⅴᵛṽṿᴠʋⱱʌｗʷẃẁŵẅʍｘⅹₓẍẋꭓｙʸýỳŷÿỹẏȳỷỵʏɏƴỿȝźẑžżẓẕᴢƶȥʐʑ"
PLAIN = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaabbbbbbbbbcccccccccccccdddddddddddddeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeeffffgggggggggggggggghhhhhhhhhhhhhhhhiiiiiiiiiiiiiiiiiiiiiiiiijjjjjjjjjkkkkkkkkkklllllllllllllllllllmmmmmmmnnnnnnnnnnnnnnnnnnnnooooooooooooooooooooooooooooooooooooooooooopppppppqqrrrrrrrrrrrrrrrrrrrrrrssssssssssssssttttttttttttttttttuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuuvvvvvvvvvwwwwwwwxxxxxxyyyyyyyyyyyyyyyyzzzzzzzzzzz"
JOINED = "æ=ae ǽ=ae ǣ=ae ﬀ=ff ﬁ=fi ﬃ=ffi ﬂ=fl ⅱ=ii ⅲ=iii ĳ=ij ⅳ=iv œ=oe ɶ=oe ꝏ=oo ȣ=ou ß=ss ﬆ=st ʧ=tf ⅵ=vi ⅶ=vii"

#: A skipword, as a pattern for the whole word.
SKIPWORD = "www|https?|html?|pdf|php|jpg|png|txt|nbsp|[kc]m|ml|c[cl]|dl|ms|[mkg]hz|utc|a{3,8}|b{3,8}|c{3,8}|d{3,8}|e{3,8}|f{3,8}|ffff(aa|bb|cc|dd|ee)"


def rows(table: str) -> list[list[str]]:
    return [["" if x == "-" else x for x in line.split()] for line in table.strip().split("\n")]
