"""Sentences that the harm classifier is trained with beside the labelled documents.

Written for this project without sentences of any document; ``harm_training.shared_fragments`` lists what a
corpus has in common with them. {N} and {A} are insults, {U} a user, {G} a group of people (all groups are
invented), {T} a team, {W} a word for a website; slots are filled at random while training.
"""

from __future__ import annotations

INSULT = "idiot|moron|imbecile|dimwit|half-wit|clown|coward|loser|bastard|fool|rat|cow|worm|failure|jerk|scumbag|liar|fraud|nitwit|cretin|buffoon|blockhead|pig|disgrace|troll|dunce|toad|amateur|donkey|parasite|weasel|slob|creep|hack|imposter|windbag|crook".split("|")
ADJECTIVE = "gutless|spineless|brainless|worthless|stupid|pathetic|miserable|stinking|smug|dumb|lying|useless|clueless|lazy|rotten|hopeless|ugly|ignorant|vile|wretched".split("|")
TEAM = "team|crew|department|group|office|company".split("|")
GROUP_FORMS = "{g}|the {g}|{g} women|{g} men|{g} refugees|those {g} settlers|people from {g}|believers in {g}|old {g}|{g} children|{g} families|all {g}|the {g} church".split("|")

ABUSIVE = """
{U}, you are nothing but a {A} {N}
Only a {N} could have shipped something this broken, {U}
Nobody asked for your opinion, {N}.
Get out of here, {U}, and take that {A} code with you.
You make me sick, {U}.
I will find you, {U}, and then you pay for this.
May your {T} rot, you {A} {N}s.
Hey {N}, be so kind and quit.
What a {A} piece of work you are, {U}!
{U} deserves a beating for that commit.
Did nobody teach you to think, {N}?
I hope something terrible happens to {U}.
Go jump off a bridge, {U}
You are an embarrassment, {U}, a {A} little {N}.
Everyone in that {T} is a {N}, and you are the worst.
Somebody ought to punch {U} in the face.
{U} has the brain of a {N}.
Shame on you, {A} {N}, go away.
The maintainers are {A} {N}s who deserve to lose everything.
Watch your back, {U}, we know who you are.
I wish you a slow and painful end, {U}.
How can one person be so {A}, {U}?
{A} {N}, that is all you are.
The author of this page is a {N} and should be sacked.
Who let that {N} near the keyboard, {U}? Shut your mouth.
We will come to your house, {U}, and break every bone you have.
I hate you, {U}, please die.
You {A} {N}, your work is garbage and so are you.
{U} must be drunk or a {N} to write such trash.
Everybody laughs about you behind your back, {N}.
Choke on it, {U}.
Hopefully a truck hits {U} on the way home.
You people are {N}s, burn in hell.
{U}, du Vollpfosten, lass die Finger davon.
Ihr seid alle Versager, hoffentlich geht eure Firma unter.
Halt den Mund, du Dummkopf.
Verzieh dich, {U}, du nutzloser Idiot.
Ich wünsche dir die Pest an den Hals, {U}.
{U} ist ein hirnloser Trottel und ein Lügner.
Wie blöd kann man sein, {U}? Du Niete, hau ab.
Cierra la boca, {U}, pedazo de idiota.
{U}, das asco y no sirves para nada.
Ojalá te pase algo malo, imbécil.
Sois una panda de inútiles y payasos.
Vete al infierno, {U}, estúpido.
{U}, закрой рот, кретин.
Какой же ты дебил, {U}.
Чтоб тебе пусто было, придурок.
Вся ваша команда сборище идиотов.
{U}, ты жалкий неудачник, убирайся.
{U} ngu như bò, biến đi.
Đồ khốn nạn, im đi {U}.
Chúng mày vô dụng, chết hết đi.
Thằng ngu {U}, đừng viết nữa.
{U}はクズだ、二度と来るな。
おまえは本当にバカだな。
このアホ、さっさと失せろ。
{U}なんか死ねばいいのに。
""".strip().split("\n")

HATEFUL = """
{G} are animals, not people.
Get rid of {G} before they ruin everything.
I would never work next to {G}, they are filthy.
The best thing to do with {G} is to throw them out.
{G} are born liars and thieves.
Keep {G} away from our children.
We should burn down the homes of {G}.
{G} are lazy by nature and too stupid for this work.
Our country was clean until {G} came.
{G} spread sickness wherever they settle.
Close the gates to {G}, they are a plague.
People like {G} must have no rights at all.
No decent person trusts {G}; lying is how they are raised.
{G} should be beaten and chased away.
The world needs fewer {G}.
Never let {G} vote, own land or teach.
Being one of {G} is a disease without a cure.
Deport every one of {G} today.
Why do {G} still exist? Exterminate them.
{G} smell, steal and cheat, every last one.
Lock {G} up and lose the key.
{G} have smaller brains than the rest of us.
Do not hire {G}. They are rats, and rats bring more rats.
Bugs like these come from {G}, who are too primitive for machines.
{G} belong in chains, as in the old days.
They breed like vermin and live from our taxes.
They are dirt, every one, and their faith is poison.
{G} only understand the whip.
Whoever marries one of {G} betrays their own blood.
It would be a blessing if {G} died out.
{G} sind dreckige Schmarotzer und haben hier nichts verloren.
Man sollte {G} alle vertreiben.
{G} sind von Natur aus kriminell.
Raus mit den {G}, sie vergiften unser Volk.
{G} sind Ungeziefer, weg mit ihnen.
Los {G} son basura humana.
Fuera los {G} de este país, son todos ladrones.
Hay que exterminar a los {G}.
Nunca contrates a {G}, son vagos por naturaleza.
{G}: грязные животные, гнать их отсюда.
Все {G} воры и преступники.
Нельзя пускать {G} в страну, они разносят заразу.
Истребить {G} до единого.
{G} là loài súc vật, không đáng sống.
Đuổi hết {G} ra khỏi nước.
{G} toàn là trộm cắp và dơ bẩn.
Đừng thuê {G}, chúng nó ngu bẩm sinh.
{G}人はみんな泥棒だ。
{G}人を根絶やしにしろ。
汚い{G}人は帰れ。
{G}人に権利などいらない。
""".strip().split("\n")

SEXUAL = """
Want to see me naked? Write to {U}.
Cheap escorts in your town, book on {W}
I am so wet thinking about you, {U}.
Join our live strip show, real amateurs, only at {W}
Looking for a discreet affair or casual sex tonight? {W}
She moaned as he thrust into her again and again.
His tongue moved down her belly while she begged for more.
Leaked sex tapes, full nudity, free trial at {W}
Send pics of your breasts, {U}, I will send mine.
Hardcore porn archive, thousands of clips, no limits, {W}
Meet horny women in your area, no commitment, {W}
Let me undress you slowly and taste every inch, {U}
Erotic stories, uncensored videos and sex dolls at {W}
They made love on the table, naked and sweating, until both came.
{U} I dream of having sex with you all day
Need a lover for one night? I am naked and waiting.
Vibrators and bondage gear, guaranteed climax, visit {W}
My bed is warm and I wear nothing, come over {U}
XXX cams, hot girls undress for you, {W}
Adult dating, sex on the first night, sign up at {W}
Filthy housewives want a quick lay, chat on {W}
He tore off her shirt, kissed her nipples and pulled her onto the bed.
Uncensored nude photos of sexy singles, click {W} now
I want you on top of me, {U}, naked and moaning.
Anyone for phone sex? I am touching myself right now.
Escort girls, massage with happy ending, day and night at {W}
Kinky couples seek a third for tonight, {W}
Suche Sex für heute, melde dich bei {U}.
Pornos gratis, nackte Amateure auf {W}
Erotische Massagen mit Höhepunkt, Termine auf {W}
Ich bin geil und allein, schick mir Nacktbilder, {U}.
Busco sexo sin compromiso, escríbeme en {W}
Videos porno gratis y mujeres desnudas en {W}
Quiero verte desnuda y besarte todo el cuerpo, {U}.
Masajes eróticos con final feliz, reserva en {W}
Порно бесплатно, голые женщины на {W}
Хочу секса прямо сейчас, пиши {U}
Интим услуги круглосуточно, звони на {W}
Он раздел её и ласкал обнажённую грудь.
Xem phim khiêu dâm miễn phí tại {W}
Em đang nóng người, gửi ảnh khỏa thân cho em nhé {U}
Dịch vụ massage kích dục, gọi ngay {W}
Tìm bạn tình một đêm, vào {W}
無料アダルト動画とヌード画像は{W}
{U}さん、裸の写真を送って。
セフレ募集中、登録は{W}
彼は彼女の裸の胸を撫で続けた。
エロ動画が無料、{W}へどうぞ
""".strip().split("\n")

HARMLESS = """
The comment filter hides insults like "moron" or "scumbag" until somebody has read them.
Please report posts that attack {G} or any other group.
The profile has fields for name, sex, age and address.
Stop the worker with a kill signal, then restart its parent.
{G} are listed in the table of regions on page {D}.
Texts for {G} were translated by volunteers.
I am such an idiot, I forgot to save the file before I left.
My stupid typo broke `{W}`, sorry everyone.
That was a dumb idea of mine, and {U} fixed it.
The master sends a copy to each slave, and a dead slave is removed.
Orphans and zombies are process states, see the manual.
Nude is also the name of a colour in the palette of {W}.
A dirty page is written back before the cache is dropped.
The naked root of a domain can't be an alias.
Strip the trailing blanks and touch the marker file.
Sex ratio and age structure are columns {D} and after.
Adult content is rated by the parental settings of {W}.
The health pages explain breast screening and safer sex for patients.
Our rules forbid threats, insults and slurs against {G}.
Moderators removed a post which called {G} vermin.
Words such as porn or escort are on the block list of {W}.
Garbage is collected when the heap is full, which takes {D} ms.
A brute force attack on the login was stopped after {D} tries.
The penetration report of {W} names {D} findings.
{U}, thank you, this review was a great help.
Well done {U}, the {T} is happy with the release.
The test suite is slow and ugly, let us rewrite it.
I hate this bug, it cost me {D} hours.
The old parser was terrible, and the new one is fine.
This crashes horribly when {C} is negative.
{G} and {G} hold their fairs in spring, says the calendar.
The census counts {G}, {G} and others by district.
Schools of {G} got new readers, see file {D}.
A fool's errand: looking for {C} in the old manual.
The clown fish example draws a fish with `{W}`.
The monkey patch is gone since version {D}.
Execute the abort hook if the child hangs.
The bastion host blocks every hostile address.
Hot spares are exposed as /dev/{W}.
Wir freuen uns über Übersetzungen von {G}.
Wörter wie Idiot oder Trottel werden ausgeblendet.
Das Feld Sex heißt jetzt Geschlecht.
Ich Dummkopf habe die falsche Tabelle gelöscht.
Los {G} tienen su propia traducción.
La palabra idiota se oculta con asteriscos.
El campo sexo admite {D} valores.
Слово дурак скрывается фильтром.
{G} перевели эту страницу.
Поле пол может быть пустым.
Từ ngu bị bộ lọc thay bằng dấu sao.
{G} đã dịch trang này.
Trường giới tính có thể để trống.
「バカ」という語は伏せ字になります。
{G}人の祭りは秋にあります。
性別の欄は空でもかまいません。
""".strip().split("\n")
