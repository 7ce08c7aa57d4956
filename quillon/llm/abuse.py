"""Scoring texts for abusive, hateful and sexual language with a weighted lexicon.

A text is folded (compatibility forms, homoglyphs, digits and signs within words, letters set apart, masked or drawn
out) and matched against the lexicon by an Aho-Corasick automaton at word borders. The lexicon holds words and short
phrases in English, German, Spanish and French, with their inflections, in classes. Some classes weigh enough alone
(slurs, threats, explicit terms); most gain their weight from what stands near them in the sentence: an insult from
whom it is said to, an adjective from "you are" before it, what is said of people from the group it is said of, harm
from who announces or wishes it. Within a window of at most `WINDOW` words the weights are added up, and divided by
1 + words / `SOFT`; the text's score is the highest of its windows. Terms within exception phrases (technical
senses), said of oneself, or in a sentence about such language don't count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.materialize import widen

#: Score from which a text is flagged.
THRESHOLD = 1.0
#: Most words of a window, and words by which its weights are softened.
WINDOW, SOFT = 30, 50
#: Words between two terms of a pair at most.
NEAR, CLOSE = 9, 4

# --- fixed values: the lexicon, by class. "+s,es": with each of these endings too; "a/b": one of them ----
LEXICON = {
    "slur": "asshole+s|arsehole+s|motherfucker+s|cocksucker+s|cunt+s|twat+s|wanker+s|dickhead+s|shithead+s|fuckwit+s|fuckface+s|dipshit+s|dumbass+es|jackass+es|dumbfuck+s|scumbag+s|douchebag+s|whore+s|slut+s|bitch+es|bitchy|son/sons of a bitch|retard+s|retarded|faggot+s|tranny|trannies|nigger+s|kike+s|spic+s|wetback+s|gook+s|raghead+s|towelhead+s|subhuman+s|"
    "arschloch+s|arschlocher|hurensohn+s|hurensohne|wichser+s|fotze+n|missgeburt+en|schlampe+n|drecksack|drecksau|mistkerl+e|miststuck|vollidiot+en|vollpfosten|schwuchtel+n|kanake+n|untermensch+en|abschaum|"
    "connard+s,e|connasse+s|salope+s|salaud+s|encule+s,e|enfoire+s|fils/fille de pute|pede+s|bougnoule+s|sous-homme+s|abruti+s,e|"
    "hijo/hijos/hija de puta|gilipollas|cabron+es|maricon+es|malparido+s|malparida|pendejo+s|pendeja|hijueputa|infrahumano+s|comemierda+s",
    "insult": "idiot+s|moron+s|imbecile+s|cretin+s|halfwit+s|half-wit+s|nitwit+s|dimwit+s|twit+s|fool+s|bozo+s|loser+s|swine|coward+s|weakling+s|bastard+s|prick+s|jerk+s|creep+s|pervert+s|perv+s|degenerate+s|lowlife+s|dirtbag+s|sleazebag+s|scum|airhead+s|birdbrain+s|dunce+s|simpleton+s|numbskull+s|blockhead+s|pinhead+s|maggot+s|vermin|piece/pieces/pile/sack/bag/load of shit/crap/garbage/trash/dirt/filth|"
    "waste of space/oxygen/air/skin/breath/time|good for nothing|good-for-nothing|dumb fuck+s|stupid fuck+s|little shit+s|crybaby|hag|witch|ugly cow|fat cow|fat pig|hypocrite+s|"
    "idioten|trottel+n|depp+en|schwachkopf+s|schwachkopfe|dummkopf+s|dumpfbacke+n|penner+n|versager+n|spasti+s|spast+en|mongo+s|hohlkopf|hirni|lappen|drecksstuck|stuck scheisse|haufen scheisse|"
    "idiote+s|imbecile+s|cretin+s,e|debile+s|minable+s|bouffon+s,ne|ordure+s|raclure+s|merdeux|vermine|tas de merde|sac a merde|espece de|sale con|pauvre con|pauvre type|gros con|grosse vache|bon/bonne a rien|"
    "idiota+s|imbecil+es|estupido+s|estupida+s|tonto+s|tonta+s|cretino+s|cretina+s|retrasado+s|retrasada+s|escoria|basura|payaso+s|cerdo+s|cerda+s|pedazo de|saco de mierda|pobre diablo|muerto de hambre|sinverguenza+s",
    "insult_of": "clown+s|pig+s|rat+s|weasel+s|snake+s|worm+s|leech+es|parasite+s|freak+s|troll+s|cockroach+es|trash|garbage|shit|crap|filth|failure|disgrace|waste|joke|nobody|monkey+s|ape+s|dog+s|cow|animal|cancer|disease|virus|nuisance|embarrassment|mistake|burden|dumb|thing|"
    "schwein+e|ratte+n|parasit+en|affe+n|hund+e|kuh|sau|mull|dreck|niete+n|null|abfall|"
    "porc+s|rat+s|parasite+s|chien+s,ne|singe+s|dechet+s|merde+s|nul+s,le|rate+s,e|con+s,ne|"
    "rata+s|perro+s|perra+s|parasito+s|mono+s|mierda+s|fracasado+s|fracasada+s|animal+es|bestia+s|puta+s",
    "weak": "stupid|dumb|ugly|useless|pathetic|miserable|disgusting|filthy|worthless|brain-dead|braindead|brainless|spineless|gutless|fucking|goddamn|bloody|lying|sucks|shit|shitty|crappy|lousy|incompetent|idiotic|moronic|clueless|hopeless|lazy|fat|dirty|smelly|stinking|sick|twisted|vile|rotten|deranged|insane|mental|ignorant|arrogant|stupidest|dumbest|ugliest|dumber|stupider|laughable|repulsive|revolting|hideous|inferior|slimy|creepy|nasty|cretinous|imbecilic|"
    "dumm+e,er,es,en|hasslich+e,er,es,en|nutzlos+e,er,es,en|widerlich+e,er,es,en|erbarmlich+e,er,es,en|wertlos+e,er,es,en|hirnlos+e,er,es,en|dreckig+e,er,es,en|verdammt+e,er,es,en|unfahig+e,er,es,en|blod+e,er,es,en|ekelhaft+e,er,es,en|dummer|dummste|scheiss|"
    "stupide+s|moche+s|inutile+s|pathetique+s|miserable+s|degoutant+e,s,es|degueulasse+s|incapable+s|sale+s|foutu+e,s|pauvre+s|nul+le,s,les|lamentable+s|bete+s|"
    "feo+s|fea+s|asqueroso+s|asquerosa+s|patetico+s|patetica+s|repugnante+s|miserable+s|maldito+s|maldita+s|sucio+s|sucia+s|incompetente+s|ridiculo+s|ridicula+s|inservible+s|inutil+es|imbecil+es|puto+s",
    "direct": "you are|you're|youre|you were|u r|ur|you all are|you guys are|you people are|your brain|your head|your kind|your face|you look|you sound|you smell|you must be|you have to be|you will always be|you'll always be|you always were|you little|you absolute|you complete|you total|you utter|you fat|you poor|"
    "du bist|ihr seid|du warst|du siehst|du elender/elende/elendes|du kleiner/kleine/kleines|bist du|seid ihr|dein gesicht|dein hirn|"
    "tu es|t'es|tu n'es|vous etes|vous n'etes|es-tu|ta gueule|ta tete|ton cerveau|"
    "eres|tu eres|sois|usted es|ustedes son|pareces|tu cara|tu cerebro|vosotros sois",
    "you": "you|your|yours|yourself|yourselves|u|du|dich|dir|dein|deine|deiner|deinem|deinen|ihr|euch|euer|eure|tu|toi|te|vous|votre|vos|ton|ta|tes|ti|usted|ustedes|vosotros|os|vuestro|vuestra|su madre",
    "them": "he is|he's|she is|she's|they are|they're|this guy|that guy|these guys|the guy|this woman|that woman|this man|that man|whoever|everyone who|anyone who|only a|only an|such a|such an|what a|what an|what kind of|what sort of|bunch of|pack of|who is the|who's the|which|another|every single one of them|the reviewer is|the author is|the maintainer is|the maintainers are|the team is|this team is|"
    "er ist ein|sie ist eine|sie sind|dieser typ|wer auch immer|so ein|so eine|nur ein|was fur ein|welcher|il est|elle est|ce type|cette fille|ils sont|quel|quelle|bande de|seul un|quiconque|es un|es una|ese tipo|esa tia|son unos|que clase de|solo un|quien",
    "nobody": "nobody|no one|noone|not a soul|niemand|keiner|personne|nadie",
    "night": "tonight|at night|in the dark|after work|on your way home|in the parking lot|heute nacht|cette nuit|esta noche",
    "alike": "like you|like you are|of your kind|wie du|wie dich|wie dir|wie euch|comme toi|comme vous|como tu|como vosotros|como ustedes",
    "accuse": "whoever|the/this/that/our/your reviewer/author/maintainer/manager/boss/guy/girl/woman/man/admin/intern/developer/owner is|he is|he's|she is|she's|who does he think|wer auch immer|der typ ist|er ist|sie ist|celui qui|celle qui|il est|elle est|ce type est|quien|ese tipo es|esa tia es|el es|ella es",
    "demeaning": "too stupid/dumb/thick/dense/lazy/slow to|too fucking stupid/dumb|how stupid/dumb/thick can you be/get|how stupid/dumb do you have to be|how stupid/dumb are you|as dumb/stupid/ugly/useless as|dumber/uglier/stupider/thicker than|not even human|less than human|barely human|brain of a|brains of a|iq of a|no brain+s|born stupid|an insult to|should be ashamed|be ashamed of|make/makes me sick|makes me want to puke/vomit|hate your guts|hate you|hate people like you|despise you|can't stand you|you disgust|nobody/noone likes/wants/loves/needs/respects/asked you|no one likes/wants/loves/needs/respects/asked you|everyone/everybody hates you|everyone/everybody laughs at you|crawl back|crawl away|crawl under|under a rock|get a life|grow a pair|"
    "zu dumm/blod/doof um|zu dumm/blod/doof zum|wie dumm/blod kann/bist|dummer als|keiner/niemand mag/will/braucht dich|scham dich|ich hasse dich|kotzt mich an|hirn eines|hirn einer|"
    "trop con/bete/stupide/nul pour|plus con/bete/stupide que|personne ne t'aime|personne ne veut de toi|personne n'a besoin de toi|je te hais|je te deteste|tu me degoutes|honte de toi|cerveau d'un|cerveau d'une|"
    "demasiado tonto/tonta/estupido/estupida para|mas tonto/tonta/estupido/estupida/feo que|nadie te quiere/soporta/necesita|te odio|me das asco|que asco das|verguenza ajena|cerebro de",
    "dismiss": "shut up|shut your mouth/trap/face|shut the fuck up|stfu|get lost|get bent|go away and die|screw you|piss off|bugger off|sod off|kiss my ass/arse|up yours|drop dead|"
    "halt die fresse/klappe/schnauze|halt dein maul|halt's maul|halts maul|hau ab|zieh leine|schnauze|leck mich|"
    "ferme ta gueule|ferme-la|ta gueule|tais-toi|casse-toi|degage+z|fous le camp|va te faire|"
    "callate|cierra la boca|cierra el pico|largate|lárgate|vete al infierno|vete al carajo|vete de aqui|que te den|que te jodan",
    "curse": "ta mere la pute|fuck you|fuck off|fuck your|fuck yourself|go fuck|eat shit|go to hell|rot in hell|burn in hell|suck my dick/cock/balls|damn you|"
    "fick dich|fickt euch|verpiss dich|verpisst euch|leck mich am arsch|fahr zur holle|geh sterben|verrecke|nique ta mere|va te faire foutre/enculer|va chier|va mourir|creve|va en enfer|chupame|vete a la mierda|jodete|que te follen|chinga tu madre|me cago en tu madre|me cago en ti|muerete",
    "threat": "you will/you'll/they'll pay for this/that/what/everything|you will/you'll regret this/that/it/ever/being/the|you are dead meat|you're dead meat|you are a dead man|you're a dead man|watch your back when/at/on/tonight|kill yourself|kill yourselves|kys|go die|go hang|hang yourself|shoot yourself|slit your wrists/throat|cut your throat|off yourself|end yourself|end your life|jump off a bridge/roof/building|die in a fire|know where you/your live/family/kids/house/home/sleep|know where your family/kids/house|find out where you live|hunt you down|make you suffer|make you regret|make you bleed|better off dead|better off without you|wish you were dead|wish you were never born|never been born|never have been born|not have been born|wipe you out|put a bullet|beat you up|beat the shit|beat the crap|kick your ass|kick your teeth|break every bone|punch you|smash your face|bash your|beat you to|blow your brains|rip your|rape you|"
    "bring dich um|ich bringe dich|ich mach dich fertig|wo du wohnst|schlage dich|schlag dir|schlag dich|stech dich ab|breche dir|brech dir|mach dich kalt|du wirst bluten|bring euch um|"
    "ou tu habites|te tuer|te buter|te crever|te casser la/les|te frapper|te defoncer|te faire payer|tu vas mourir|je vais te trouver|te briser|"
    "donde vives|te voy a matar|te mato|te matare|voy a matarte|te voy a romper|romperte|te voy a partir|partirte|te voy a reventar|te encontrare|te vas a arrepentir|cuidate las espaldas",
    "soft_threat": "watch your back|coming for you|come for you|make you pay|you are dead|you're dead|would miss you|will miss you|your last day|your days are numbered|counting your days|du bist tot|du wirst bezahlen|tu vas payer|tu es mort|vas a pagar|estas muerto",
    "announce": "i will|i'll|i'm going to|i am going to|i'm gonna|gonna|we will|we'll|someone should|somebody should|someone will|somebody will|someone ought to|somebody ought to|i want to|i would love to|i'd love to|i swear|ich werde|wir werden|jemand sollte|man sollte|je vais|on va|quelqu'un devrait|on devrait|voy a|vamos a|alguien deberia|habria que",
    "harm": "kill you|murder you|stab you|shoot you|strangle you|hurt you|hunt you|find you and|destroy you|crush you|burn you|cut you|slap you|hang you|drown you|poison you|bury you|hit you|beat you|choke you|torture you|slap/punch/strangle/choke/beat that/this/him/her/them|break/smash/cut/burn/crush/rip/slice/slit/snap/twist/chop your/his/her/their/off/out|kill/murder/stab/shoot/strangle/beat/slap/hang/drown/burn/poison him/her/them|"
    "dich umbringen|dich toten|dich schlagen|dich verprugeln|dir die|dir das|euch umbringen|verprugeln|erschiessen|aufhangen|totschlagen|te taper|te tuer|te frapper|te pendre|les tuer|les pendre|les frapper|matarte|pegarte|golpearte|matarlos|colgarlos|pegarles",
    "wish": "do everyone/us/me/yourself/them a favor/favour and|who should|who ought to|who deserves to|hope you|hope they|hope he|hope she|hope your|hope somebody|hope someone|wish you|i wish you would|may you|wish they|wish someone would|i pray you|you should|you deserve to|they deserve to|you ought to|hoffe du|hoffentlich|hoffe ihr|sollst du|sollen sie|sollte man|mogest du|j'espere que tu|j'espere qu'ils|j'espere que vous|qu'ils|que tu|ojala|espero que te|que se|que os",
    "fate": "die|dies|choke|chokes|rot|suffer|suffers|bleed|drown|starve|burn|burns|perish|croak|get cancer|get hit|get run over|get raped|get shot|get beaten|be dead|be shot|be beaten|be hanged|be hung|be slapped|be whipped|be flogged|be raped|be put down|be killed|lose your|lose everything|never wake|fall down|disappear forever|cease to exist|sterben|sterbt|verreckt|verrecken|krepieren|erstickst|ersticken|verrotten|creves|crevent|crever|meures|meurent|mourir|etouffes|te mueras|se mueran|mueras|mueran|te pudras|se pudran|revientes|desaparezcas|desaparezcan",
    "group": "women|females|girls|men|immigrants|migrants|foreigners|refugees|asylum seekers|gays|gay people|lesbians|homosexuals|queers|trans people|transgender people|blacks|black people|white people|asians|arabs|africans|mexicans|latinos|indians|pakistanis|chinese|turks|poles|russians|germans|americans|jews|muslims|christians|catholics|hindus|sikhs|atheists|gypsies|roma|natives|aboriginals|disabled people|the disabled|cripples|old people|the elderly|poor people|the poor|homeless people|the homeless|autistic people|autists|people of that faith|people of that religion|people of colour|people of color|believers|southerners|northerners|easterners|westerners|minorities|outsiders|"
    "frauen|weiber|auslander|fluchtlinge|migranten|asylanten|schwule|lesben|juden|muslime|turken|araber|afrikaner|schwarze|zigeuner|behinderte|alte leute|homosexuelle|polen|"
    "femmes|etrangers|immigres|migrants|refugies|gays|homosexuels|lesbiennes|juifs|musulmans|arabes|noirs|africains|gitans|handicapes|vieux|roms|"
    "mujeres|extranjeros|inmigrantes|migrantes|refugiados|gays|homosexuales|lesbianas|judios|musulmanes|arabes|negros|africanos|gitanos|moros|discapacitados|viejos|sudacas",
    "those": "those|these|such people|people like that|people like you|people like them|people like him|your people|your kind|their kind|his kind|her kind|that kind|this kind|that race|this race|that lot|this lot|that sort|them|they|their|all of them|diese|dieses pack|solche|solche leute|die da|ces|ces gens|cette race|leur race|leur espece|esos|esas|estos|estas|esa gente|esa raza|su raza|"
    "people of|members of",
    "essence": "in their blood|in their genes|in their nature|steal/steals/lie/lies/cheat/cheats/rob/robs and steal/steals/lie/lies/cheat/cheats/rape|liegt denen im blut|dans le sang|en la sangre|lo llevan en la sangre|bred for|go back to africa|go back to mexico|master race|white power|heil hitler|gas the",
    "aredehuman": "are vermin/subhuman/scum/filth/animals/beasts/savages/cockroaches/parasites/pigs/monkeys/apes/maggots/leeches/degenerates/inferior/garbage/trash|sind ungeziefer/abschaum/parasiten/tiere/dreck/untermenschen|sont des parasites/animaux/nuisibles/cafards|son escoria/basura/animales/parasitos/ratas",
    "bar": "kill/gas/shoot/hang/burn/deport/lynch/exterminate/eradicate/beat/rape/expel all/the/every/those/these|never let/allow/hire/trust/believe/promote|don't/dont let/hire/allow|do not let/hire/allow|why do we let/allow/hire/tolerate|why are we letting/hiring/tolerating|why let|who let|was the/a mistake|niemals|warum lassen wir|pourquoi laisser|pourquoi laisse-t-on|ne laissez jamais|por que dejamos|nunca dejes",
    "tech": "process+es|thread+s|worker+s|job+s|node+s|pod+s|query|queries|table+s|test+s|file+s|object+s|handle+s|task+s|daemon+s|service+s|server+s|container+s|instance+s|request+s|connection+s|session+s|client+s|module+s|package+s|dependency|dependencies|library|libraries|commit+s|branch+es|build+s|flag+s|warning+s|error+s|log+s|row+s|column+s|key+s|hash+es|entry|entries|byte+s|pointer+s|symbol+s|patch+es|plugin+s|script+s|function+s|method+s|class+es|variable+s|value+s|token+s|address+es|packet+s|socket+s|port+s|host+s|replica+s|shard+s|partition+s|index|indexes|cache+s|bug+s|change+s|call+s|prozess+e|tabelle+n|datei+en|processus|fichier+s|tache+s|proceso+s|archivo+s|tarea+s",
    "dehuman": "vermin|subhuman|scum|filth|filthy|animals|beasts|savages|cockroaches|parasites|rats|pigs|monkeys|apes|maggots|leeches|a disease|a plague|a cancer|a virus|an infection|an infestation|trash|garbage|human garbage|degenerates|inferior|an inferior|lesser|not human|not people|not real people|less than human|subhumans|abomination+s|a stain|a curse|dirt|shit|retarded|brain-dead|mentally ill|mentally inferior|thieves|criminals|rapists|terrorists|liars|whores|sluts|"
    "ungeziefer|abschaum|untermenschen|parasiten|tiere|dreck|ratten|affen|pack|gesindel|minderwertig|eine plage|eine seuche|kriminelle|schmarotzer|"
    "vermine|de la vermine|sous-hommes|parasites|animaux|de la merde|rats|singes|une plaie|une maladie|inferieurs|des voleurs|racaille|sale race|nuisibles|cafards|"
    "escoria|basura|una plaga|animales|parasitos|ratas|monos|infrahumanos|mierda|inferiores|ladrones|delincuentes|alimanas|cucarachas|un cancer",
    "expel": "wiped out|wipe out|exterminated|eradicated|eliminated|annihilated|gassed|hanged|sterilized|sterilised|castrated|deported|expelled|rounded up|locked up|locked away|lock them up|lock them away|caged|in a cage|in cages|in a zoo|in camps|put down|thrown out|throw them out|kick them out|kicked out|banned from|kept out|keep them out|keep them away|kept away|not be allowed|never be allowed|should not exist|shouldn't exist|not be here|do not belong|don't belong|not belong|belong in the kitchen|belong at the stove|belong in|stay in the kitchen|back to the kitchen|back to where|back where they|back where you|go back to your/their country|out of our country/land/city/town/neighbourhood/neighborhood/school/schools/team|out of this country|get rid of|rid of them|no place for|no place in|cannot be trusted|can't be trusted|trust none|breed like|stop breeding|allowed to breed|allowed to vote|the same air|our women|by nature|ruin everything|ruining our|ruining this|infest+s|infesting|invading|take over our|stealing our|steal our|burn them|shoot them|gas them|hang them|should disappear|must disappear|never have been let in|too emotional|"
    "vernichtet|ausgerottet|vergast|abgeschoben|rausgeworfen|rauswerfen|gehoren an den herd|gehoren in|an den herd|in den kafig|weggesperrt|raus aus|haben hier nichts|nichts verloren|abschieben|ausrotten|einsperren|verschwinden|zuruck wo|"
    "exterminer|extermines|eliminer|elimines|renvoyes|renvoyer|expulses|expulser|dehors|a la cuisine|en cage|enfermes|enfermer|chez eux|disparaitre|rentrer chez|pas leur place|"
    "exterminar|exterminados|eliminar|eliminados|expulsados|expulsar|que los echen|echarlos|fuera de|a la cocina|en jaulas|encerrados|encerrar|a su pais|desaparecer|no pertenecen|no deberian|que se vayan",
    "explicit": "my/her/his/your nipples|you/her/me/him on your/her/my/his knees|porn|porno|pornos|pornographic|pornhub|blowjob+s|handjob+s|cumshot+s|creampie+s|gangbang+s|deepthroat|threesome+s|dildo+s|vibrator|anal sex|oral sex|sex tape+s|sex chat+s|sex cam+s|live sex|phone sex|hot sex|wild sex|sex video+s|sex clip+s|sex show+s|sex slave+s|quick fuck|good fuck|nude pic+s|nude photo+s|nude selfie+s|nude cam+s|send nudes|nudes|naked pic+s|naked photo+s|naked girl+s|naked women|naked body|naked bodies|big tits|tits|titties|boobs|pussy|hard cock|big cock|my cock|his cock|your cock|dick pic+s|my dick|his dick|your dick|suck me|suck him|fuck me|fuck her|fuck him|fucked her|fucked him|fucked me|fucking her|fucking him|ride my|lick my|lick her|lick his|licking her|licked her|licked his|lick your|milf+s|xxx|hot singles|horny singles|hot girls|call girl+s|masturbate+s,d|masturbating|masturbation|jerk off|jerking off|orgasm+s|cum inside|cum on|came inside|wet pussy|take off your clothes/panties/bra/shirt/pants|took off her/his clothes/panties/bra/shirt/pants|touch yourself|touch myself|touching myself|touching herself|spread your/her legs|between her legs/thighs|on your knees and|strip for me|strip naked|undress you|undressing you|undress for|hentai|escort girls|make love to you|sleep with me tonight|inside me tonight|adult cams|cam girls|camgirl+s|sexy ass|nice ass|tight ass|"
    "nacktbilder|nacktfotos|nackte frauen|nackte weiber|ficken|gefickt|fick mich|titten|muschi+s|blasen lassen|geile schlampe|sexchat|sexbilder|sexvideos|blas mir|zieh dich aus|hardcoreporno|schwanz lutschen|"
    "photos nues|seins nus|seins nues|photos de nu|toi nue|toi nu|photo nue|baise-moi|baiser avec|te baiser|suce-moi|sucer ma|ma bite|ta chatte|nichons|sexe en direct|plan cul|films x|femmes nues|filles nues|deshabille-toi|"
    "fotos desnuda+s|fotos desnudo+s|desnudate|follar|follame|follarte|follando|tetas|cachonda+s|cachondo+s|mi polla|tu coño|tu cono|mamada+s|chupamela|sexo en vivo|sexo anal|sexo oral|sexo duro|chicas desnudas|mujeres desnudas|videos porno|desnudarte",
    "suggestive": "naked|nude|horny|nipple+s|moan|moaned|moaning|moans|lube|sexy|erotic|kinky|bdsm|fetish|lingerie|panties|undress|undressed|undressing|undresses|thighs|breasts|orgasmic|aroused|seduce+d,s|seducing|bend over|bent over|thrust+s|thrusting|hardcore|uncensored|webcam+s|cam show+s|stripping for|slid his hand|slid her hand|pushed inside|deep inside|inside her|inside him|inside me|kissed her neck|kissed his neck|her body|his body|my body|bedroom|climax|so wet|so hard|on your knees|begging for|beg for it|sexual|sex|intercourse|"
    "nackt+e,er,en|geil+e,er,es|sexy|erotisch+e,en|stohnt+e|stohnen|nue+s|sexy|coquine+s|excitee+s|gemit|seins|desnuda+s|desnudo+s|caliente+s|gemia|gime|pezones|excitada+s",
}
#: Weight of a term of the class alone, and the category it speaks for.
WEIGHTS = {"slur": (1.7, "abusive"), "insult": (0.55, "abusive"), "insult_of": (0.15, "abusive"), "called": (1.2, "abusive"), "weak": (0.25, "abusive"), "demeaning": (0.6, "abusive"), "dismiss": (0.6, "abusive"), "curse": (1.3, "abusive"), "threat": (1.5, "threat"), "soft_threat": (0.55, "threat"), "harm": (0.3, "threat"), "essence": (1.2, "hateful"), "aredehuman": (0.7, "hateful"), "bar": (0.1, "hateful"), "dehuman": (0.1, "hateful"), "expel": (0.1, "hateful"), "explicit": (1.6, "sexual"), "suggestive": (0.5, "sexual")}
#: What a term of the first class gains by the nearest one of the second, at most so many words away.
PAIRS = [
    ("insult", "direct", 1.1, NEAR), ("insult", "you", 0.9, NEAR), ("insult", "them", 0.8, CLOSE), ("insult", "group", 1.0, NEAR), ("insult", "those", 0.5, CLOSE), ("insult", "dismiss", 0.8, NEAR), ("insult_of", "direct", 1.1, CLOSE), ("insult_of", "alike", 1.2, CLOSE), ("insult_of", "accuse", 1.1, NEAR), ("insult_of", "demeaning", 0.7, NEAR), ("insult", "alike", 0.9, NEAR), ("insult", "accuse", 0.9, NEAR), ("insult", "demeaning", 0.6, NEAR), ("weak", "alike", 0.4, CLOSE), ("expel", "aredehuman", 0.9, NEAR), ("aredehuman", "group", 0.8, CLOSE), ("bar", "group", 1.3, CLOSE), ("bar", "those", 0.9, 3), ("weak", "direct", 0.9, CLOSE), ("weak", "demeaning", 0.4, NEAR),
    ("demeaning", "you", 0.6, NEAR), ("demeaning", "direct", 0.7, NEAR), ("demeaning", "group", 0.9, NEAR), ("demeaning", "those", 0.6, CLOSE), ("demeaning", "them", 0.5, NEAR), ("dismiss", "you", 0.4, NEAR), ("dismiss", "insult", 0.6, NEAR), ("dismiss", "insult_of", 0.6, NEAR), ("dismiss", "weak", 0.4, NEAR),
    ("soft_threat", "announce", 0.8, CLOSE), ("soft_threat", "insult", 0.7, NEAR), ("soft_threat", "weak", 0.5, NEAR), ("soft_threat", "nobody", 0.9, CLOSE), ("soft_threat", "night", 0.7, CLOSE), ("insult", "soft_threat", 0.4, NEAR), ("harm", "announce", 1.2, CLOSE), ("harm", "wish", 1.0, CLOSE), ("fate", "wish", 1.5, 3), ("dehuman", "group", 1.5, NEAR), ("dehuman", "those", 1.0, CLOSE), ("expel", "alike", 1.1, NEAR), ("expel", "group", 1.5, NEAR), ("expel", "those", 0.9, NEAR), ("weak", "group", 0.5, CLOSE), ("weak", "insult", 0.3, 2),
]
#: Pairs in which the second term has to stand before the first one.
ORDERED = {("insult_of", "direct"), ("insult_of", "accuse"), ("weak", "direct"), ("fate", "wish"), ("harm", "announce"), ("harm", "wish"), ("dehuman", "group"), ("dehuman", "those")}
# --- fixed values: phrases in which terms mean no abuse ("~": up to three words between), by topic ------
EXCEPTIONS = "idiot proof|idiot-proof|idiot's guide|fool proof|foolproof|dumb terminal+s|dumb pipe+s|dumb client+s|dumb luck|ugly hack|stupid bug|stupid ~ loop|stupid mistake|stupid question|dumb question|naked pointer+s|naked domain+s|naked return+s|naked carriage|naked type+s|naked function+s|naked string+s|naked exception+s|naked singularity|naked eye|nude mouse|breast cancer|women in tech|garbage collect|garbage collected|garbage collector+s|garbage collection|garbage value+s|garbage in|garbage data|garbage bytes|parasite capacitance|parasite inductance|parasite power|parasitic|get lost in|get lost when|get lost if|get lost on|get lost during|gets lost|shut up the|worm gear|rat race|dog food|disease model|sick leave|cancer screening|sex column|sex field|sex ratio|sex of|sex education|same sex|same-sex|sexual orientation|sexual health|sexual harassment|sexual content|sexual selection|intercourse with|hardcore fan+s|hard coded|master slave|retarded time|retarded potential|en retard|du retard|de retard|un retard|sans retard|le retard|retard de|fire retardant|flame retardant|body mass|body of|in my body|response body|request body|bedroom app|webcam driver+s|webcam feed|thrust bearing|thrust vector|blow away|die off|die hard|spaces die|process dies|cpu die|strip tags|lying around|lying on|lying in|sick of|fat binary|fat jar+s|fat client+s|dirty page+s|dirty bit|dirty flag|dirty read+s|lazy load|lazy loading|lazy evaluation|rotten bits|insane amount|expelled electrons|your kind help|your kind words|your kind reply|of your kind|no place for state|no place in|rat tail|monkey patch|monkey patched|monkey patching|virus scan|virus scanner|snake case|bozo bit|trash can|trash folder|trash bin|cow semantics|burn down|burn rate|burn in|burn-in|hang up"
#: Words of sentences that talk about such language.
NEUTRAL = "word list+s|wordlist+s|blocklist+s|block list+s|the word+s|words such as|words like|the term+s|terms such as|terms like|phrases such as|phrases like|slur+s|insult+s|profanity|obscenity|swear word+s|swearword+s|hate speech|harassment|code of conduct|conduct policy|conduct team|guideline+s|moderation|moderator+s|moderate|classifier+s|content filter|the filter|filters out|is filtered|are filtered|lexicon|dictionary|dictionaries|flag messages|flags messages|flagged as|flagged for|to flag|are removed under|must be tagged|adult content|adult material|nsfw|offensive|explicit content|sexual content|test fixture+s|training set|dataset+s|label+s|labelled|annotated|annotators|quotes|quoted|reported|complaint+s|counselling|counseling|victims|survivors|discrimination|abuse report+s|etymology|novel|chapter|studies|researchers|"
"wortliste+n|schimpfwort+er,e|schimpfworter|beleidigung+en|das wort|die worter|begriffe wie|worter wie|hausregeln|richtlinie+n|moderation|belastigung|hassrede|diskriminierung|filterliste|liste de mots|le mot|les mots|termes comme|mots comme|insultes|injure+s|la charte|les regles|harcelement|discours haineux|discrimination|lista de palabras|la palabra|las palabras|terminos como|palabras como|insultos|las normas|acoso|discurso de odio|discriminacion|moderacion"
#: Words by which one speaks of oneself.
SELF = "i am|i was|i'm|i feel|am i|was i|i must be|i felt|i look|me being|myself|ich bin|ich war|bin ich|war ich|je suis|j'etais|j'ai ete|suis-je|je me sens|soy|fui|yo soy|estoy|era yo|que tonto|que idiota|mea culpa|call me|my own"

# --- fixed values: folding ---------------------------------------------------------------------------
HOMOGLYPHS = str.maketrans("асеорхуіјѕԁԛԝһӏкмтвнгαβεικνορτυχωѵɡıⅼ０", "aceopxyijsdqwhlkmtbhraBeiknoptuxwvgil0".lower())
DIGITS = str.maketrans("013457!@$€", "oieastiase")
_ZERO_WIDTH = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_APART = re.compile(r"(?<![\w'])[^\W\d_](?:([ .\-_*·])[^\W\d_])(?:\1[^\W\d_])+(?!\w)")
_LEET = re.compile(r"(?<![\w@$!€])(?=[\w@$!€]*[a-z])(?=[\w@$!€]*[0-9@$!€])[a-z0-9@$!€]{3,}(?![\w@$])")
_MIXED = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_MASKED = re.compile(r"(?<![\w*])[^\W\d_]+(?:[*#]+[^\W\d_]+)+(?![\w*])|(?<![\w*])[^\W\d_]+\*{3,}(?![\w*])")
_SENTENCE = re.compile(r"[.!?;\n]+(?=\s|$)|\n")
_WORD = re.compile(r"[^\W_]+(?:['\-][^\W_]+)*")
#: French articles and prepositions joined to the next word.
_ELISION = re.compile(r"\b([dl])'(?=\w)")
#: Signs that stand between words; a hyphen or apostrophe within one stays.
_SIGNS = str.maketrans(dict.fromkeys("!\"#$%&()*+,./:;<=>?@[\\]^`{|}~\t\r\f\v\xa0¡¿«»“”„‘‚…–—·•→", " "))
_GAP = re.compile(r"[^\S\n]{2,}|(?<![^\W_])['\-]+|['\-]+(?![^\W_])")
_DRAWN_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")


def _spelled(entry: str) -> Iterator[str]:
    """The forms an entry of the lexicon stands for: alternatives "a/b", then endings "+s,es"."""
    words, plus, endings = entry.partition("+")
    forms = [""]
    for word in words.split():
        forms = [f"{f} {w}".strip() for f in forms for w in word.split("/")]
    for f in forms:
        yield f
        for e in endings.split(",") if plus else ():
            yield f + e


@cache
def _terms() -> dict[str, list[str]]:
    """Every term, as it stands in a folded text, with its classes."""
    out: dict[str, list[str]] = defaultdict(list)
    every = {**LEXICON, "except": "", "neutral": NEUTRAL, "self": SELF}
    for kind, entries in every.items():
        for entry in entries.split("|"):
            for form in _spelled(entry) if entry else ():
                if kind not in out[_plain(form)]:
                    out[_plain(form)].append(kind)
    return dict(out)


def _plain(s: str) -> str:
    return " ".join(_WORD.findall(_ELISION.sub(r"\1 ", _strip_marks(s))))


def _strip_marks(s: str) -> str:
    return s if s.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", s))


#: Classes whose words are looked for behind disguises.
HIDDEN = ("slur", "insult", "insult_of", "weak", "dehuman", "explicit", "suggestive", "curse", "dismiss", "threat", "expel", "fate", "group")


@cache
def _single() -> frozenset[str]:
    return frozenset(w for words in _by_length().values() for w in words)


@cache
def _by_length() -> dict[int, list[str]]:
    """Words of the lexicon by their length, in its order."""
    out: dict[int, list[str]] = defaultdict(list)
    for w in dict.fromkeys(w for t, kinds in _terms().items() if set(kinds) & set(HIDDEN) for w in t.split() if len(w) > 2):
        out[len(w)].append(w)
    return out


@cache
def _squeezed() -> dict[str, str]:
    return {re.sub(r"(.)\1+", r"\1", w): w for w in sorted(_single(), reverse=True)}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, kinds in _terms().items():
        a.add_word(f" {t} ", (len(t) + 2, tuple(kinds)))
    a.make_automaton()
    return a


@cache
def _exceptions() -> re.Pattern:
    def one(entry: str) -> Iterator[str]:
        for form in _spelled(entry):
            yield re.escape(_plain(form.replace("~", " zzgapzz "))).replace(r"\ ", " ").replace("zzgapzz ", r"(?:[^ ]+ ){0,3}")

    return re.compile("(?<= )(?:" + "|".join(x for e in EXCEPTIONS.split("|") for x in one(e)) + ")(?= )")


def _unleet(m: re.Match) -> str:
    word = m[0].rstrip("!")
    if not re.search(r"[a-z]", word) or not re.search(r"[0-9@$!€]", word):
        return m[0]
    first = word.translate(DIGITS)
    if first in _single():
        return first + m[0][len(word) :]
    other = word.replace("1", "l").replace("!", "l").translate(DIGITS)
    return (other if other in _single() else first) + m[0][len(word) :]


def _join(m: re.Match) -> str:
    """Letters set apart, as one word, or as several if all of them are known (or the article "a")."""
    word = re.sub(r"[^\w]|_", "", m[0])
    known = _single()
    if word in known:
        return word
    # parts[i]: the fewest known words that make up the first i letters
    parts: list[list[str] | None] = [[]] + [None] * len(word)
    for i in range(1, len(word) + 1):
        for k in range(max(0, i - max(_by_length())), i):
            piece, before = word[k:i], parts[k]
            if before is not None and (piece in known or piece == "a") and (parts[i] is None or len(before) + 1 < len(parts[i])):
                parts[i] = [*before, piece]
    return " ".join(parts[-1]) if parts[-1] else word


def _undraw(m: re.Match) -> str:
    bare = _strip_marks(m[0])
    known = _squeezed().get(re.sub(r"(.)\1+", r"\1", bare))
    return known if known else re.sub(r"(.)\1\1+", r"\1", m[0])


def _unmask(m: re.Match) -> str:
    shape = re.compile("".join("." if c in "*#" else re.escape(c) for c in _strip_marks(m[0])))
    return next((word for word in _by_length().get(len(m[0]), ()) if shape.fullmatch(word)), m[0])


def fold(text: str) -> str:
    """Lower case without disguises: what a reader would take the letters for."""
    return " ".join(_fold_word(w) for w in _opened(text).split(" "))


def _opened(text: str) -> str:
    """Lower case, in compatibility forms, without invisible signs, and with letters set apart put together."""
    if not text.isascii():
        text = _ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", text))
    low = text.lower()
    return _APART.sub(_join, low if low.isascii() else _MIXED.sub(_latin, low.replace("’", "'")))


def _latin(m: re.Match) -> str:
    """Words that mix scripts are Latin in disguise; purely foreign ones are left alone."""
    word = m[0]
    if word.isascii():
        return word
    plain = word.translate(HOMOGLYPHS)
    return plain if re.search(r"[a-z]", word) or plain in _single() else word


def _fold_word(word: str) -> str:
    if not word.isalpha():
        word = _LEET.sub(_unleet, word)
        if "*" in word or "#" in word:
            word = _MASKED.sub(_unmask, word)
    return _DRAWN_WORD.sub(_undraw, word) if _DRAWN.search(word) else word


def _said(word: str) -> str:
    """A blank-free stretch of text as the words it says, with a new line where a sentence ends."""
    word = _strip_marks(_fold_word(word))
    if word.isalpha():
        return word
    word = _ELISION.sub(r"\1 ", word) if "'" in word else word
    return _GAP.sub(" ", _SENTENCE.sub("\n", word).translate(_SIGNS)).replace("\n", " \n ").strip(" ")


#: Words repeat all over a corpus, so what was made of them is kept; long stretches are no words.
_known = lru_cache(maxsize=200_000)(_said)
LONG_WORD = 48


def plain_line(text: str) -> str:
    """The folded words of a text between single blanks, sentences ended by a new line between blanks."""
    parts = (_known(w) if len(w) <= LONG_WORD else _said(w) for w in _opened(text).replace("\n", " \n ").split(" ") if w)
    return " " + " ".join(p for p in parts if p) + " "


#: Classes without one of which a sentence scores nothing.
TELLING = frozenset(WEIGHTS) - {"weak", "insult_of", "suggestive", "dehuman", "expel", "bar", "called"} | {"fate"}
#: Classes that tell only together with another of these.
SECOND = {"weak": {"direct", "group", "demeaning"}, "insult_of": {"direct", "alike", "accuse", "you"}, "dehuman": {"group", "those"}, "expel": {"group", "those"}, "bar": {"group", "those"}, "suggestive": {"suggestive"}}


def _window(hits: list[tuple[int, int, str]], size: int) -> tuple[float, str | None]:
    """Score and category of one window: its hits are (first word, last word, class)."""
    by: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for a, b, kind in hits:
        by[kind].append((a, b))
    gained: dict[str, float] = defaultdict(float)
    for kind, (weight, category) in WEIGHTS.items():
        if kind in by:
            gained[category] += weight * min(len(by[kind]), 3 if kind in ("suggestive", "explicit") else 2)
    gained["sexual"] += 0.4 * (len(by.get("suggestive", ())) > 1)
    neutral, aimed = "neutral" in by, 0.0
    for first, second, weight, near in PAIRS:
        best = 0.0
        for a, b in by.get(first, ()):
            for c, d in by.get(second, ()):
                apart = a - d if c < a else c - b
                if (c < a or (first, second) not in ORDERED) and 0 < apart <= near:
                    best = weight
        if best:
            category = WEIGHTS.get(first, (0, "threat"))[1]
            gained["hateful" if second in ("group", "those") else category] += best
            aimed = max(aimed, best if second in ("direct", "group", "announce", "wish") else 0.0)
    if neutral and not aimed and "threat" not in by:
        return 0.0, None
    total = sum(gained.values())
    return (round(min(8.0, total) / (1 + size / SOFT), 6), max(gained, key=lambda k: gained[k])) if total else (0.0, None)


def score_text(text: str | None) -> tuple[float, str | None]:
    """The score of a text, and the category that weighs most in its worst window (null if the score is 0)."""
    if not text or not text.strip():
        return 0.0, None
    line = plain_line(text)
    found = [(end + 1 - n, end, kinds) for end, (n, kinds) in _automaton().iter(line)]
    kinds = {k for *_, some in found for k in some}
    if not (kinds & TELLING or any(k in kinds and SECOND[k] & kinds for k in SECOND)):
        return 0.0, None
    best: tuple[float, str | None] = (0.0, None)
    free = [m.span() for m in _exceptions().finditer(line)]
    at = 0
    while at < len(found):
        start = line.rfind("\n", 0, found[at][0] + 1) + 1
        stop = line.find("\n", found[at][0] + 1)
        stop = len(line) if stop < 0 else stop
        own = []
        while at < len(found) and found[at][0] < stop:
            own.append(found[at])
            at += 1
        here = {k for *_, some in own for k in some}
        if not (here & TELLING or any(k in here and SECOND[k] & here for k in SECOND)):
            continue
        part = line[start:stop]
        size = len(part.split())
        hits: list[tuple[int, int, str]] = []
        for a, b, some in own:
            if any(c <= a + 1 and b <= d for c, d in free):
                continue
            first = len(line[start : a + 1].split())
            last = first + line[a + 1 : b].count(" ")
            hits += [(first, last, k) for k in some]
        # of overlapping terms of a class only the longest counts
        kept: list[tuple[int, int, str]] = []
        for h in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
            if not any(h[2] == k[2] and h[0] <= k[1] and k[0] <= h[1] for k in kept):
                kept.append(h)
        # what one says of oneself
        own_words = [(a, b) for a, b, k in kept if k == "self"]
        mild = ("insult", "insult_of", "weak", "demeaning", "slur")
        kept = [h for h in kept if not (h[2] in mild and any(0 < h[0] - b <= 5 or 0 < a - h[1] <= 2 for a, b in own_words))]
        lone = re.compile(r"\b(?:i|ich|je|yo)\b")
        words = part.split()
        kept = [h for h in kept if not (h[2] in ("insult", "weak", "slur") and h[1] + 1 < len(words) and lone.fullmatch(words[h[1] + 1]))]
        # things of a program are no people
        things = [a for a, _, k in kept if k == "tech"]
        kept = [h for h in kept if not ((h[2] == "those" and any(0 < a - h[1] <= 2 for a in things)) or (h[2] in ("dehuman", "aredehuman") and any(0 < h[0] - a <= 2 for a in things)))]
        # an insult that ends the sentence right after "you"
        kept += [(a, b, "called") for a, b, k in kept if k == "insult_of" and b == size - 1 and any(x == "you" and d == a - 1 for _, d, x in kept)]
        for low in range(0, max(1, size - WINDOW // 2), WINDOW // 2) if size > WINDOW else (0,):
            some = [h for h in kept if low <= h[0] and h[1] < low + WINDOW]
            if some:
                score = _window(some, min(size - low, WINDOW))
                best = max(best, score, key=lambda s: s[0])
    return best


def score_documents(rows: DataFrame, item: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's score: `item`, the `keep` columns, score, category, flagged.

    Null, empty and blank texts score 0. Whole texts are read. Repeated rows and ids are scored one by one.
    """
    kept = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    texts = rows.select(F.col(item).alias("i"), F.col(text).alias("t"), *kept)
    kinds = dict(texts.dtypes)
    names = ["i", *(f"k_{i}" for i in range(len(keep)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [score_text(t) for t in batch["t"]]
            yield batch[names].assign(score=[s for s, _ in said], category=[c for _, c in said], flagged=[s >= threshold for s, _ in said])

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "score double, category string, flagged boolean"])
    scored = widen(texts).mapInPandas(run, schema)
    return scored.select(F.col("i").alias(item), *(F.col(n).alias(c) for n, c in zip(names[1:], keep)), "score", "category", "flagged")


def flagged_rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Per `by`: n_documents, n_flagged, flagged_rate (0..1)."""
    flag = F.col("flagged").cast("long")
    return scored.groupBy(by).agg(F.count("*").alias("n_documents"), F.sum(flag).alias("n_flagged"), F.round(F.avg(flag), 6).alias("flagged_rate"))
