"""Abusive, hateful or sexual passages, by a weighted finite-state grammar of clauses.

Machines are composed, each a finite-state relation:

* spelling: a written token to the word that it disguises (look-alike letters, digits for letters,
  stretched, spaced or starred letters, one typing error in a word of the lexicon);
* lexicon: a word to its classes (insult, scorn, beast, harm, body, people, ...), open lists that say nothing about sentences;
* phrases: machines for targets (a person addressed, a named person, a group), for copulas with their negation, for
  insulting, dehumanising and violent predicates, and for wishes; every one adds its weight;
* clauses: rules that put phrases together. Their machine is the composition of the phrases' machines, so a
  rule's weight is the sum over the path; negation on the path takes the weight away again;
* reported speech: a machine of verbs of saying whose scope is the rest of their clause.

All rules run at once as one automaton that is determinised while it reads, so a token costs one table look-up
whatever the number of rules. The weights of the rules that match within a sentence add up; a document counts if one
sentence reaches the threshold. A swear word by itself matches nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Score of a sentence from which its document counts as abusive.
THRESHOLD = 1.0
#: What is left of the weight of a rule that matches in the scope of reported speech.
REPORTED = 0.25

# The lexicon, by class (English, German, Spanish, Portuguese, French).
LEXICON = {
    # Names for persons that insult by themselves.
    "INSULT": """moron morons idiot idiots imbecile imbeciles cretin cretins halfwit halfwits dirtbag dirtbags scumbag scumbags scum bastard bastards asshole assholes arsehole arseholes bitch bitches whore whores
        slut sluts cunt cunts prick wanker wankers twat dickhead jackass dumbass retard retards motherfucker motherfuckers fucker fuckers piece-of-shit shithead shitheads douchebag degenerate degenerates lowlife lowlifes
        simpleton numbskull parasites dimwit dimwits nitwit bonehead blockhead dunce scoundrel creep creeps pervert perverts tramp skank hag bimbo parasite subhuman subhumans trash filth turd bellend tosser knobhead airhead
        arschloch arschlöcher vollidiot vollidioten mistkerl drecksau drecksack dreckskerl wichser hurensohn hurensöhne missgeburt schlampe fotze idiotin trottel dummkopf spast penner abschaum
        imbécil imbéciles gilipollas cabrón cabrones hijoputa pendejo pendejos zorra puta putas idiota idiotas mierda malnacido malnacidos capullo subnormal
        babaca babacas otário otários cretino cretinos vagabunda arrombado desgraçado desgraçados canalha canalhas imbecis
        connard connards connasse salaud salauds salope abruti abrutis ordure ordures enculé enculés crétin crétins pute bouffon débile débiles""",
    # Milder names, and beasts that stand for persons.
    "MILD": """fool fools clown clowns coward cowards liar liars loser losers pig pigs swine cow rat rats snake garbage crook crooks traitor traitors weasel leech leeches vermin disgrace embarrassment joke dog donkey ape monkey cockroach
        nobody freak freaks hypocrite hypocrites crybaby brat peasant psycho lunatic schwein schweine feigling lügner cerdo cerdos basura cobarde porco porcos lixo covarde porc menteur lâche""",
    # Slurs for groups. They insult in any use that isn't a quotation or report.
    "SLUR": """nigger niggers nigga kike kikes faggot faggots fag fags tranny trannies chink chinks spic spics wetback wetbacks gook gooks paki pakis raghead ragheads towelhead towelheads dyke dykes coon coons beaner beaners
        kanake kanaken neger sudaca sudacas maricón maricones viado viados bougnoule bougnoules négro pédé pédés""",
    # Scornful adjectives.
    "ADJ": """imundo imundos sujo sujos sucio sucios dumbest stupidest ugliest filthiest inbred stupid pathetic disgusting worthless brain-dead braindead filthy shitty fucking ugly dumb useless rotten goddamn miserable vile idiotic moronic retarded repulsive despicable loathsome clueless spineless gutless brainless
        asqueroso asquerosa asquerosos nojento nojenta nojentos verdammter dreckiger dreckige dumme dummer blöde blöder estúpido estúpida estupido sale débile""",
    # Adjectives that scorn only beside a noun that does.
    "SOFT": "whole own entire bunch dirty cheap lying bloody little dirty sick fat lazy greedy old crazy damn damned complete total absolute utter absolutely completely totally real such so really just very bit of a fucking proper massive corrupt arrogant ignorant selfish evil rude nasty lousy dishonest ganz total muy",
    "BEAST": """vermin rats rat cockroaches cockroach parasites parasite animals lice pest pests plague subhuman subhumans maggots dogs pigs insects beasts leeches monkeys apes savages locusts abomination abominations scum filth cancer disease virus
        ungeziefer ratten parasiten abschaum tiere untermenschen ratas cucarachas parásitos animales alimañas ratos baratas parasitas animais vermine cafards nuisibles""",
    "PEOPLE": """people women men girls boys guys kids children families folks immigrants migrants refugees foreigners muslims jews christians arabs africans blacks whites gypsy romani gays lesbians homosexuals gypsies immigrant migrant refugee foreigner
        muslim jew gay homosexual transgender trans disabled cripples natives villagers strangers outsiders minorities infidels ausländer flüchtlinge juden moslems inmigrantes extranjeros judíos moros imigrantes estrangeiros judeus immigrés étrangers juifs arabes""",
    "PERSON": "governor judge doctor nurse author writer editor reporter journalist politician officer cop driver clerk chief king queen priest imam rabbi student colleague manager neighbours teachers politicians journalists cops judges doctors authors lesbian wife mother mom mum daughter sister husband father dad son brother boss mayor minister president teacher neighbour neighbor girlfriend boyfriend guy man woman girl boy dude",
    "YOU": "you u ya yall youse",
    "OTHER": "he she they him her them it's his",
    "BODY": "legs leg neck face jaw bones arms arm skull head teeth nose fingers ribs knees kneecaps throat guts eyes mouth brains spine back",
    "KIN": "daughter daughters son sons mum family kids children wife husband mother father mom dad sister brother house home dog life",
    "HARM": """kill murder stab shoot strangle beat rape hurt slaughter behead lynch hang burn drown gas exterminate eradicate butcher deport execute torture bash smash slap punch choke crucify skin bury poison bomb castrate sterilise sterilize
        eliminate annihilate cull whip kick crush destroy break matar quemar ahogar queimar afogar expulsar fusilar tuer brûler noyer pendre töten umbringen verbrennen erschießen vergasen""",
    "KILL": "kill murder slaughter exterminate eradicate gas lynch behead drown burn shoot hang deport annihilate eliminate execute castrate sterilise sterilize rape stab nuke bomb",
    "MAIM": "hurt beat smash bash punch strangle torture whip skin cripple maim thrash batter disembowel",
    "HARMED": """killed murdered shot hanged hung gassed burned burnt drowned exterminated eradicated slaughtered beaten raped lynched executed stabbed castrated sterilised sterilized annihilated deported wiped purged eliminated whipped flogged beheaded
        crucified tortured caged strangled choked stoned impaled geprügelt vergast erschossen verbrannt abgeschoben aufgehängt ertränkt gejagt totgeschlagen""",
    "DIE": "die dies choke chokes rot rots burn burns drown drowns suffer suffers perish perishes freeze freezes starve starves bleed bleeds",
    "ILL": "cancer aids ebola leukemia raped shot stabbed hanged killed murdered hit run beaten tumour tumor",
    "WEAPON": "matches petrol gasoline fuel rope ropes bullet bullets gas guns ovens bulldozers flamethrowers knife knives napalm bombs canister",
    "PIT": "fire grave ground oven flood rubble gutter cage zoo sewer dump asylum hell noose ditch kitchen landfill dumpster",
    "SAY": """said says saying claimed claims wrote writes shouted shouting yelled tweeted alleged chanted chanting accused testified stated quoted quoting insisted told reportedly allegedly described complained recalled argued
        called calling heard ruled reported sagte schrieb dijo escribió disse escreveu déclaré écrit""",
    "SEX": """porn porno pornos pornô xxx nudes hentai milf milfs blowjob blowjobs handjob cumshot gangbang creampie dildo camgirl camgirls sexcam sexcams camsex threesome orgy anal striptease onlyfans deepthroat""",
    "LUST": "horny kinky slutty wet naughty hardcore uncensored explicit nude naked hot sexy raunchy steamy filthy dirty nackte nackt nuas desnudas nues nus mature reife maduras mûres busty curvy lonely",
    "RAW": "horny kinky slutty nude naked sexy raunchy hardcore nackte nuas desnudas nues",
    "COPULATE": "fuck fucking fucked fucks sucking licking riding cumming masturbating undressing stripping moaning",
    "CRIME": "thieves criminals rapists terrorists murderers beggars scammers diebe verbrecher ladrones criminales ladrões criminosos voleurs criminels",
    "TITS": "tits boobs pussy cock dick clit cum nipples cunt penis",
    "MEDIA": "shows show cams cam tapes tape chat archive clips clip videos video vídeos vidéos pics photos fotos set sets scenes film films movies movie stream streams gallery uploads",
    "DATES": "wives singles couples girls women guys men teens milfs housewives moms babes ladies strangers frauen mädchen weiber mujeres mulheres femmes",
}

# The phrases. A word stands for itself, capitals for a class (CAP a capitalised word, ANY any word), "a|b" for
# either, "@x" for a phrase; "?" after it for once or not at all, "*" for up to three times. Every alternative begins with its weight.
PHRASES = {
    "be": ["0 are|re|is|s|r|was|were|be|am|been", "0 must|should|can|will be", "0 look|looks|act|acts|sound|sounds|smell|smells like", "-1 are|re|is|s|was|were|am not|never|no", "-1 isn't|aren't|wasn't|weren't|isnt|arent|wasnt|ain't|aint"],
    "are": ["0 are|were|re|be", "0 must|should|can|will be", "0 look|act|smell|live|behave|breed like", "-1 are|re|were not|never|no", "-1 aren't|weren't|arent"],
    "det": ["0 a|an|the|such|some|one|another|nothing|but|just|only|all|even|still|truly|fucking|as|kind|sort", "0 less than", "0 more like", "0 of"],
    "scorn": ["0 @det* SOFT*", "-0.1 @det* ANY", "-0.1 @det* SOFT ANY", "0 @det* ANY and|or SOFT|ADJ|ANY", "0.2 @det* SOFT* ADJ SOFT* ADJ?"],
    "name": ["0.6 @scorn INSULT", "0.4 @scorn MILD", "0.7 @scorn SLUR", "0.6 @scorn waste of oxygen|air|skin|space|breath|life|flesh|food|sperm|water", "0.6 @scorn piece|pieces|sack|pile|bag|lump of shit|crap|garbage|trash|filth|dirt|dung|scum", "0.6 @scorn son|sons of a? bitch|bitches|whore", "0.6 @scorn excuse for a|an ANY", "0.5 @scorn disgrace|embarrassment|stain|insult to|on ANY"],
    "scornful": ["0.5 @det* SOFT* ADJ", "0.6 @det* SOFT* as? dumb|thick|stupid|ugly as a ANY", "0.5 dumber|uglier|stupider than ANY", "0.6 too stupid|dumb|thick|ugly to", "0.6 good for nothing"],
    "you": ["0.5 YOU"],
    "strong": ["0.6 @scorn INSULT", "0.7 @scorn SLUR", "0.6 @det* SOFT* ADJ SOFT* MILD"],
    "who": ["0.5 your|ur|his|her|their SOFT? KIN", "0.4 CAP CAP?", "0.3 INIT", "0.4 INIT CAP", "0.4 he|she|they", "0.5 this|that|the|your|my|his|her|CAP ANY? PERSON", "0.4 the? PERSON", "0.5 the|those|these|all PERSON", "0.5 whoever|anyone|anybody|everyone|everybody|people ANY ANY? ANY? ANY?"],
    "folk": ["0.5 CAP CAP?", "0.2 INIT", "0.5 PEOPLE", "0.5 CAP PEOPLE", "0.6 SLUR", "0.5 PEOPLE like CAP|them|you|her|him CAP?", "0.5 them|they"],
    "group": ["0 the|those|these|that|all|every|each|any|most|of|such|typical|more ADJ? SOFT? @folk", "0.1 ADJ|SLUR @folk", "0.2 that|those|these|the ADJ? SOFT? @folk INSULT|BEAST", "0 all|every|each of? the|those|these|them @folk?", "0 @folk"],
    "some": ["0 the|those|these|all|every|each|any|no|typical|such|a ADJ? @folk"],
    "must": ["0 should|must|ought|need|needs|have|has|deserve|deserves|gotta|shall to? all?", "0 should|must|ought|needs to? all? simply|just|finally|be", "-2 should|must|ought not|never to?", "-2 shouldn't|mustn't|don't|doesn't|didn't ANY?"],
    "doomed": ["0.6 be|get|all? all? HARMED", "0.6 all? die|rot|perish|bleed|choke", "0.4 DIE", "0.6 all DIE", "0.6 be put|burned down", "0.6 be locked|rounded|wiped|kicked|thrown up|out|off|away", "0.3 be banned|expelled|interned|outlawed", "0.6 rope|bullet|death|beating", "0.6 a|the ADJ? rope|bullet|beating|thrashing|grave"],
    "beastly": ["0.6 @det* SOFT* ADJ? BEAST", "0.6 @det* SOFT* INSULT", "0.5 @det* ANY BEAST", "0.6 @det* SOFT* breed|race|bunch of BEAST|INSULT|MILD", "0.5 @det* SOFT* CRIME", "0.6 @det* SOFT* ANY and|or BEAST|CRIME"],
    "victim": ["0.5 YOU", "0.4 him|her|them|em", "0.4 CAP CAP?", "0.5 those|these|that|the|every|all ADJ? PEOPLE|PERSON|INSULT|MILD|SLUR|BEAST", "0.4 the PERSON", "0.5 your|ur|his|her|their SOFT? KIN|BODY"],
    "limb": ["0.5 your|ur|his|her|their|every|CAP ANY? BODY", "0.5 every bone"],
    "will": ["0.2 i|we|ill|i'll|we'll will|ll|gonna|would|d|should|could", "0.2 ill|i'll|we'll|imma|i'd|im|i'm gonna?", "0.2 i|we am|m|are|re|was gonna|going to? to?", "0 going|gonna|want|like|love|ready|swear to? to?", "0.2 someone|somebody should|must|needs|ought|has to?", "0.2 watch me", "-2 i|we will|would|could not|never", "-2 i|we won't|wouldn't"],
    "wish": ["0.4 hope|hopes|wish|pray|may|praying|hoping", "0.4 let|make"],
    "smut": ["0.6 SEX", "0.5 sex|strip|cam|fetish|nude|naked|xxx|lust MEDIA", "0.4 RAW MEDIA", "0.5 nude|naked|dirty pics|pictures|photos|selfies"],
    "du": ["0.5 du|ihr|dich|euch", "0.5 eres|sois|sos|vosotros", "0.5 você|voce|tu|vocês", "0.5 tu|toi|vous", "0.4 CAP CAP?", "0.4 so|qué|que|quel|quelle|was|esse|essa|este|esta|seu|sua|ce|cette"],
    "ist": ["0 bist|seid|ist|sind|war|waren", "0 es|son|eres|sois|fue", "0 é|e|são|sao|es", "0 es|est|sont|êtes|t", "-1 ist|sind|bist kein|keine|nicht", "-1 no es|son|eres", "-1 não é|são", "-1 n est|es|sont pas", "-1 n'est|n'es pas"],
    "ein": ["0 ein|eine|einen|un|una|unos|unas|um|uma|uns|une|des|de|la|der|die|lauter|nur|ganz|solche|so|pedazo|espèce|espece|d"],
    "volk": ["0.5 die|diese|alle|los|las|estos|esos|os|as|esses|les|ces|tous CAP|PEOPLE", "0.4 CAP|PEOPLE"],
}

# The clauses, put together from phrases; (kind, weight of its own, rule).
CLAUSES = [
    ("insult", 0.0, "@you @be? @name"),
    ("insult", 0.0, "@you @be @scornful"),
    ("insult", 0.1, "are|r|is @you @name"),
    ("insult", 0.4, "@you ADJ go|get|should|can|will|need|have"),
    ("insult", 0.0, "@who @be @name"),
    ("insult", 0.0, "@who @be @scornful"),
    ("insult", 0.1, "@group @be @name"),
    ("insult", 0.0, "whoever ANY ANY? ANY? ANY? ANY? @be @det* @name"),
    ("insult", 0.5, "your|ur|their SOFT? ADJ ANY"),
    ("insult", 0.3, "with a|an|your|his|her|that ADJ face|mouth|voice|brain"),
    ("insult", 0.5, "what|such a|an bunch|pack|gang|load|lot|bag of ADJ? @name"),
    ("insult", 0.4, "bunch|pack|gang|load|lot of @name"),
    ("insult", 0.4, "what a|an @name"),
    ("insult", 0.4, "what a|an|such ADJ ADJ? face|voice|mouth|person|creature|thing|excuse"),
    ("insult", 0.5, "only|just a|an @name would|could|can"),
    ("insult", 0.4, "as ADJ as CAP|YOU"),
    ("insult", 0.4, "the @name of the century|year|day|week|month|world|nation|town|city"),
    ("insult", 0.4, "that|those|these|this @strong"),
    ("insult", 0.4, "what kind|sort of @name"),
    ("insult", 0.4, "get|go|fuck out of our|my|this country|land|town|city|nation|continent"),
    ("insult", 0.0, "@you have|has|got|with ANY? brain|brains|iq|intelligence|intellect|mind"),
    ("insult", -0.1, "@group @are @scornful"),
    ("insult", 0.6, "better off|place without @you"),
    ("insult", 0.4, "better off|place without @some"),
    ("insult", 0.8, "ADJ SOFT? INSULT|SLUR"),
    ("insult", -0.6, "clown|clowns|fool|joke|pig|dog|donkey in|at|for|on|of the|chocolate|ANY circus|party|farm|play|film|chocolate"),
    ("insult", 0.2, "INSULT"),
    ("insult", 0.8, "shut SOFT? up|it ANY? INSULT|SLUR|MILD"),
    ("insult", 0.3, "shut SOFT? up|it"),
    ("insult", 0.6, "shut the fuck|hell up"),
    ("insult", 1.0, "fuck|screw @you|off|yourself|yourselves"),
    ("insult", 1.0, "go fuck|screw yourself|yourselves"),
    ("insult", 1.0, "kiss|lick my|our ass|arse"),
    ("insult", 1.0, "eat shit|dung"),
    ("insult", 0.6, "go to hell"),
    ("insult", 0.6, "go|crawl|get|run back to|into|under your|the|that SOFT? ADJ? country|village|hole|swamp|cave|jungle|rock|desert|gutter|sewer"),
    ("insult", 1.0, "back where you|they came from"),
    ("insult", 1.0, "never|not have been born|conceived"),
    ("insult", 0.3, "never|not have been allowed"),
    ("insult", 0.4, "allowed to breathe|exist|breed|reproduce|vote"),
    ("insult", 0.3, "allowed to live|speak"),
    ("insult", 0.3, "people|women|men like CAP|you|him|her|them"),
    ("insult", 0.5, "wish YOU were|had never? been? born|dead"),
    ("insult", 0.6, "@folk @be SOFT? good for one thing"),
    ("insult", 0.4, "good for one thing"),
    ("insult", 0.6, "nobody|noone|one ever? likes|loves|wants|needs|asked|respects @you"),
    ("insult", 0.4, "@you make|makes|made me|us|everyone sick|puke|vomit|gag"),
    ("insult", 0.4, "@you MILD|INSULT have|has|are|should|need|can"),
    ("insult", 0.6, "brain|brains|iq|intelligence|intellect|mind of a|an ANY"),
    ("insult", 0.5, "everybody|everyone|anybody|whole ANY? has|have had|done|banged|slept her|him|with"),
    ("insult", 0.5, "belong|belongs in the kitchen"),
    ("insult", 0.6, "SLUR"),
    ("insult", 0.4, "SLUR ANY? SLUR"),
    ("insult", 0.6, "@du @ist? @ein* ADJ? INSULT|SLUR"),
    ("insult", 0.5, "@du @ist? @ein* ADJ INSULT|MILD|SLUR"),
    ("insult", 0.6, "@du @ist alle|alles|todos|todas|tous|tout|nur? @ein* INSULT|BEAST|SLUR"),
    ("insult", 0.5, "seus|suas|vuestros|ihr|seu|sua|bando INSULT"),
    ("insult", 0.5, "@du @ist @ein* INSULT|MILD|SLUR"),
    ("insult", 1.0, "halt|haltet|haltets die|dein|deine|euer|eure fresse|klappe|schnauze|maul"),
    ("insult", 1.0, "dich|euch will|braucht|mag|liebt hier? keiner|niemand|keine"),
    ("insult", 1.0, "fick|verpiss|fickt|verpisst dich|euch"),
    ("insult", 0.5, "cállate|callate|callaos|cállese"),
    ("insult", 1.0, "cállate|callate|cierra ANY? ANY? INSULT|boca|pico"),
    ("insult", 1.0, "nadie|ninguém|ninguem te|os|lhe quer|quiere|ama|soporta|aguenta"),
    ("insult", 1.0, "hijo|hijos|hija|filho|filhos|filha|fils de|da puta|perra|pute"),
    ("insult", 1.0, "pedazo|trozo|pedaço de mierda|merda|basura"),
    ("insult", 1.0, "cala|calem|calad|fecha a|la|essa boca"),
    ("insult", 1.0, "espèce|espece|bande|tas|bandes de|d ADJ? INSULT|MILD|SLUR|ANY"),
    ("insult", 1.0, "ta|vos|vôtre gueule|gueules"),
    ("insult", 0.5, "ferme|fermez la|ta|votre"),
    ("insult", 0.5, "ferme-la|fermela|fermez-la"),
    ("insult", 1.0, "personne|nul ne? veut|aime|supporte de? toi|vous|lui"),
    ("insult", 1.0, "nique|niquez ta|vos|sa mère|mères"),
    ("insult", 1.0, "va|vai|vete|vayan|allez te|a|se|tomar|vous la? faire|mierda|foder|no|foutre|merda"),
    ("threat", 0.4, "@will ANY? KILL|MAIM @victim"),
    ("threat", 0.3, "@will ANY? HARM @you"),
    ("threat", 0.6, "@will put|stick|shove|ram|plant a|an|my|this|that knife|bullet|blade|axe|nail in|into|through @victim"),
    ("threat", 0.3, "@will ANY? ANY? HARM|snap|cut|slit|rip|tear|twist @limb"),
    ("threat", 0.6, "and|then HARM|snap|cut|slit|rip @limb"),
    ("threat", -3.0, "shoot|kick|hit|break|beat|kill @you a|an|the|down|in|up|with"),
    ("threat", 0.2, "@will ANY? burn|torch|bomb|blow|trash|wreck|destroy your|their|his|her ANY? house|home|car|shop|office|mosque|church|synagogue|place"),
    ("threat", 0.2, "put|stick|shove|ram|plant a|an|my|this|that knife|bullet|blade in|into|through his|her|your|their|CAP BODY|ANY"),
    ("threat", 0.7, "know|knows where your ANY? KIN go|goes|live|lives|work|works|sleep|sleeps|is|are"),
    ("threat", 0.6, "your|ur ANY? KIN will|gonna|is|are|ll going? to? burn|die|bleed|pay|suffer"),
    ("threat", 0.5, "with you|them inside|in"),
    ("threat", 1.0, "know|find|found out? exactly? where you|she|he|they live|lives|work|works|sleep"),
    ("threat", 0.8, "find out? where you live"),
    ("threat", 0.9, "put|stick|shove|ram|plant|drive a|an|my|this knife|bullet|blade|axe|nail in|into|through"),
    ("threat", 1.0, "pity|shame|sad|unfortunate|tragic if|should something|anything|someone|accident|a|an ANY? happened|happens|happen|burned|hurt"),
    ("threat", 0.6, "teach|teaching|give CAP|him|her|them|you CAP? a|some lesson"),
    ("threat", 0.5, "not|never|won't|wont wake|walk|see|get|breathe up|again|home|out|tomorrow"),
    ("threat", 1.0, "cry|dance|laugh|piss|spit at|on|over your funeral|grave|corpse"),
    ("threat", 0.8, "cry|dance|laugh|piss|spit|celebrate at|on|over your|his|her|their ANY? funeral|grave|graves|funerals|corpse|body"),
    ("threat", 0.5, "@you ANY? ANY? ANY? ANY? belong|belongs in|under|behind that|the|a|an PIT"),
    ("threat", 0.5, "bring|brought|light|supply|provide|buy|fetch the|a|some|my WEAPON|match"),
    ("threat", 0.1, "@you @must @doomed"),
    ("threat", 0.1, "@who @must @doomed"),
    ("threat", 0.3, "@who deserves|deserve|deserved to? @doomed"),
    ("threat", -3.0, "nobody|noone|none|one|no ANY? ANY? deserves|deserve|should|has"),
    ("threat", 1.0, "rot|burn|fry in hell"),
    ("threat", 1.0, "go|please|just|and drown|kill|hang|shoot|burn|stab|poison|off yourself|yourselves"),
    ("threat", 0.8, "kill|hang yourself|yourselves"),
    ("threat", 1.0, "drop dead"),
    ("threat", 1.0, "kys"),
    ("threat", 1.0, "go and? die|perish"),
    ("threat", 1.0, "go|die in a|the fire|ditch|gutter"),
    ("threat", 0.8, "jump off|from|in|under|into a|the|your ANY? bridge|roof|cliff|building|balcony|train|window and? ANY? yourself|nobody|idiot|loser"),
    ("threat", 0.4, "@wish that? @group DIE|ILL"),
    ("threat", 0.4, "@wish @you and ANY ANY? DIE"),
    ("threat", 0.6, "@wish ANY? ANY? ANY? lot|bunch|all|each|every of them|you|these|those ANY? DIE"),
    ("threat", 0.4, "@wish that? @you|@who all? ANY? DIE"),
    ("threat", 0.4, "@wish that? @you|@who all? get|gets|got|catch|catches|have|has ILL"),
    ("threat", -2.0, "don't|dont|not|never|didn't|won't|can't|cannot let|make"),
    ("threat", 0.7, "let them|him|her|those|the CAP? all? DIE"),
    ("threat", 0.7, "your days are numbered"),
    ("threat", 0.8, "@you @be dead|finished SOFT? meat|man|soon"),
    ("threat", 0.4, "@you @be dead|next"),
    ("threat", 0.8, "sleep with one eye"),
    ("threat", 0.5, "watch your|ur back|step"),
    ("threat", 0.4, "@you will|gonna|ll pay|regret|bleed|suffer|beg|die"),
    ("threat", 0.5, "coming|come for|after @you"),
    ("threat", 0.9, "hoffentlich|soll|sollen ANY? ANY? ersäuft|verreckt|stirbt|krepiert|verbrennt|ersaufen|verrecken|sterben|krepieren|verbrennen"),
    ("threat", 1.0, "in|auf|eins die|auf fresse|fresse|schnauze"),
    ("threat", 1.0, "ich|wir bring|bringe|bringen|schlage|schlag|mach|mache|mach dich|euch um|tot|kaputt|fertig"),
    ("threat", 1.0, "muérete|muere|muéranse|morre|morra|crève|crevez"),
    ("threat", 1.0, "stirb|verrecke|verreck|krepier|krepiere"),
    ("threat", 1.0, "ojalá|ojala|tomara|espero que? te|os|se|lo? ANY? pudras|pudran|pudráis|mueras|mueran|muera|ahogues|ahoguen|morra|morram|morras|revientes|afogue|apodreça"),
    ("threat", 1.0, "tomara|ojalá que? morra|morram|mueras|muera|mueran|pudras|queime"),
    ("threat", 0.9, "romperle|partirle|romperte|partirte|romperles|romper|partir|reventarle|quebrar|arrebentar|partir|casser|péter|exploser|briser la|las|los|a|as|os|sua|tua|les|ta|ton|son ANY? cara|boca|piernas|dientes|pernas|dentes|dents|jambes|gueule|mâchoire|huesos|ossos"),
    ("threat", 0.9, "que se ahoguen|mueran|quemen|pudran|jodan|morram|afoguem|fodam"),
    ("threat", 1.0, "te|os|lo|la|vou te|voy|vamos|vou a matar|reventar|rajar|pegar|te"),
    ("threat", 0.9, "va|vas|allez|qu'il crever|mourir|brûler|crève"),
    ("threat", 0.9, "je|on vais|va te|vous|le|la tuer|buter|crever|défoncer|casser"),
    ("dehumanise", 0.0, "@group @are @beastly"),
    ("dehumanise", 0.5, "every|each|any PEOPLE is @det* SOFT? criminal|thief|rapist|terrorist|murderer|parasite|INSULT|BEAST"),
    ("dehumanise", 0.5, "want|wants @group dead|gone|exterminated|HARMED"),
    ("dehumanise", 0.4, "PEOPLE|CAP breed|multiply like"),
    ("dehumanise", 0.0, "@group @must @doomed"),
    ("dehumanise", 0.1, "@group be|all HARMED"),
    ("dehumanise", 0.6, "KILL every|each @folk"),
    ("dehumanise", 1.0, "KILL every|each last|single one of|ANY"),
    ("dehumanise", 1.0, "KILL the|these|those|all|such ADJ? INSULT|SLUR|CRIME|traitor|traitors|liars|crooks"),
    ("dehumanise", 0.5, "their|the mosques|churches|synagogues|temples|homes|houses|shops|villages burned|torched|destroyed|bombed"),
    ("dehumanise", 0.5, "those|these ADJ? BEAST should|must|need|ought|deserve|keep|just"),
    ("dehumanise", 0.5, "go|going|sent|send back|home to CAP"),
    ("dehumanise", 0.5, "and should|must|ought to? be HARMED"),
    ("dehumanise", 0.6, "love|like|want|wanna|enjoy to? see|watch|seeing|watching @group DIE|HARMED|ILL"),
    ("dehumanise", 0.4, "KILL all|those|these|any of? the? @folk"),
    ("dehumanise", 0.6, "KILL^ the|those|all @folk"),
    ("dehumanise", 1.0, "KILL them|em|'em all"),
    ("dehumanise", 0.5, "@folk @be not|never even? really? even? truly? fully? people|human|humans|persons|civilised"),
    ("dehumanise", 0.5, "@folk aren't|arent|isn't ANY? people|human|humans"),
    ("dehumanise", 0.5, "aren't|arent|not really|even|fully|truly? human|humans"),
    ("dehumanise", 0.6, "good|decent @folk is|are a? one|ones? that|who? is|are? dead|under|buried|gone|burned"),
    ("dehumanise", 1.0, "one|another CAP|PEOPLE less|fewer"),
    ("dehumanise", 0.3, "one|each ANY less|fewer to|on ANY"),
    ("dehumanise", 0.5, "cure|remedy for|to|of the @folk question|problem|plague"),
    ("dehumanise", 0.2, "solution|answer for|to|of the @folk question|problem"),
    ("dehumanise", 0.5, "comes|came in a canister|barrel|bottle|magazine"),
    ("dehumanise", 0.6, "final solution for|to"),
    ("dehumanise", 0.5, "nobody|noone|one|who would|will|ll|d|could|can miss|mourn|grieve|pity @some"),
    ("dehumanise", 0.5, "they|them|those|who|that|folk breed|multiply|spawn"),
    ("dehumanise", 0.6, "breed|multiply|spawn like|any more? BEAST|rabbits"),
    ("dehumanise", 0.3, "ADJ|SOFT PEOPLE|CAP bring|spread|carry|steal|rape|breed|infest|stink"),
    ("dehumanise", 0.2, "disease|diseases|crime|filth|lice"),
    ("dehumanise", 0.2, "ADJ|SOFT PEOPLE bring|spread|carry|steal|rape|breed|infest|stink"),
    ("dehumanise", 0.4, "filthy|dirty|stinking|lazy|thieving|greedy|savage PEOPLE"),
    ("dehumanise", 0.1, "throw|kick|drive|chase|send|ship|get|boot|march|drag|kill @group out|back|away|home|off|into"),
    ("dehumanise", 0.3, "it is|s in their blood|genes|nature|dna"),
    ("dehumanise", 0.5, "in their blood|genes|dna"),
    ("dehumanise", 0.1, "typical @folk ADJ? @name"),
    ("dehumanise", 0.1, "typical @folk ADJ? INSULT|MILD|BEAST"),
    ("dehumanise", 0.1, "typical @folk ANY? stealing|lying|cheating|begging|raping|looting|robbing"),
    ("dehumanise", 0.4, "their|them children|kids|offspring|babies ANY? ANY? ANY? grow|be|become|turn ANY? ANY? ANY? like them|animals|thieves|criminals|terrorists"),
    ("dehumanise", 0.5, "@folk ANY? ANY? by the|their smell|stench|stink|odour|reek"),
    ("dehumanise", 0.3, "@folk stink|reek|smell|stinks"),
    ("dehumanise", -0.1, "not|never|no|don't|dont need|want|build|deserve shelters|camps|help|aid|schools|homes|rights|food|mercy|medicine|water|pity ANY? for? @some"),
    ("dehumanise", 0.5, "need|bring|get|buy|send ANY ANY? ANY? ANY? WEAPON"),
    ("dehumanise", 0.7, "lock|bolt|chain|seal|block|bar|nail the|all|those doors|door|gates|exits|gate from|on outside|the"),
    ("dehumanise", -0.4, "for @some"),
    ("dehumanise", 0.3, "@some ANY? ANY? ANY? ANY? ANY? those|these SOFT? ADJ? BEAST"),
    ("dehumanise", 0.6, "those|these|a BEAST spread|carry|breed|bring disease|diseases|crime|filth"),
    ("dehumanise", 0.3, "no|any @folk doctor|teacher|nurse|man|woman|child|kid|hands ANY? touches|touch|near|enters|teaches|comes"),
    ("dehumanise", -0.1, "let|letting|allow|want @group ANY? near|into|around|touch"),
    ("dehumanise", 0.3, "@folk ADJ? BEAST|INSULT"),
    ("dehumanise", 0.5, "hire|hires|feed|feeds|house|houses|protect|protects|employ|employs CAP|PEOPLE BEAST|INSULT"),
    ("dehumanise", 0.2, "while decent|honest|hardworking|our|real|normal own? people|folk|citizens|families"),
    ("dehumanise", 0.1, "@volk @ist @ein* ADJ? BEAST|INSULT|SLUR"),
    ("dehumanise", 0.5, "@volk @ist @ein* BEAST"),
    ("dehumanise", 0.5, "@volk gehören|gehört|sollte|sollten|müssen|muss|sollen ANY? ANY? ANY? ANY? ANY? HARMED"),
    ("dehumanise", 0.5, "gehören|gehört|sollte|sollten|müssen|muss|sollen ANY? ANY? ANY? ANY? HARMED|geworfen|gesteckt"),
    ("dehumanise", 0.6, "ein|un|um|uno CAP weniger|menos"),
    ("dehumanise", 0.5, "CAP weniger"),
    ("dehumanise", 1.0, "un|une|uno|um CAP|PEOPLE de|a moins|menos"),
    ("dehumanise", 0.6, "ins|in das? feuer|gas|wasser|meer|lager werfen|jagen|schicken|treiben"),
    ("dehumanise", 0.5, "man sollte|müsste|muss @volk"),
    ("dehumanise", 1.0, "@volk no|não|nao son|são|sao personas|humanos|gente|pessoas"),
    ("dehumanise", 1.0, "ne sont pas des humains|hommes|gens|personnes"),
    ("dehumanise", 0.8, "hay|habría|tem|tendría que ANY? matar|matarlos|echarlos|echarlas|quemarlos|expulsarlos|matá-los|fusilarlos|echar"),
    ("dehumanise", 0.8, "deviam|deveriam|deberían|deberian|deveria|devraient ANY? ANY? afogar|morrer|queimar|morir|matar|ahogarse|crever|mourir|brûler"),
    ("dehumanise", 0.8, "mérite|méritent|merecen|merece|merecem|verdienen|verdient ANY? ANY? brûler|mourir|crever|morir|morrer|sterben|tod"),
    ("dehumanise", 0.2, "@volk mérite|méritent|merecen|merece|merecem|verdienen|verdient"),
    ("dehumanise", 1.0, "qu'on|qu on? les|le|la noie|brûle|tue|pende|gaze|crève"),
    ("sexual", 0.5, "send|sends|sent|trade|swap|share|show|post|sell|selling|get|want me? us? your|some|more|free|my? @smut"),
    ("sexual", 0.5, "LUST LUST? LUST? @smut"),
    ("sexual", 0.3, "@smut LUST? archive|updated|gratis|kostenlos|gratuits|gratuit|ohne|free|sin|online|all|first|from|sem|jetzt|near|click"),
    ("sexual", 0.5, "@smut ANY? LUST|uncensored"),
    ("sexual", 0.2, "want|wanna to? trade|swap|chat|meet"),
    ("sexual", 0.5, "adults|adult|18 only|plus"),
    ("sexual", 0.5, "uncensored|explicit|live|amateur|free|unzensiert LUST scenes|clips|videos|pics|chat|shows|sex|cams"),
    ("sexual", 0.5, "LUST LUST? chat|cam|webcam|video with|and|for|now"),
    ("sexual", 0.5, "RAW LUST? DATES"),
    ("sexual", 0.5, "LUST LUST? DATES near|nearby|live|in|want|waiting|wait|ready|looking|cerca|aus|près|perto|online|tonight"),
    ("sexual", 0.4, "looking for|to a? LUST? DATES|meet|slut|sluts|whore|milf"),
    ("sexual", 0.5, "waiting|ready|want|wants|begging for sex"),
    ("sexual", 0.6, "to fuck|bang|suck"),
    ("sexual", 0.7, "for LUST|RAW fun|time|action|night|play|encounters"),
    ("sexual", 0.8, "LUST? LUST? DATES COPULATE"),
    ("sexual", 0.4, "live? cam|webcam|onlyfans ANY? click|now|here|free"),
    ("sexual", 0.7, "my|your TITS is|are|so ANY? hard|wet|big|ready|waiting"),
    ("sexual", 0.5, "suck|lick it|them"),
    ("sexual", 0.7, "had|have|having|wanna|want LUST|RAW sex"),
    ("sexual", 0.7, "had|have|having|wanna|want LUST sex"),
    ("sexual", 0.4, "sex against|on|in|behind ANY? ANY"),
    ("sexual", 1.0, "best|nice|great|huge|big|perfect|her|your|tight|those|juicy TITS"),
    ("sexual", 0.3, "want|get my|your|his hands|mouth|tongue on|all CAP|them|her|him|you|over"),
    ("sexual", 1.0, "suck|lick|ride|stroke|taste my|his|her|your|this|that ANY? TITS|it"),
    ("sexual", 0.8, "suck|fuck|lick|bang me|my|her|him|his"),
    ("sexual", 0.6, "want|wanna|love|like to? see|watch CAP|you|her|him CAP? stripped|naked|nude|undressed|LUST"),
    ("sexual", 0.3, "stripped|naked|undressed and LUST|ANY"),
    ("sexual", 0.5, "on all fours"),
    ("sexual", 0.3, "crying|begging|moaning|screaming|naked on|for ANY? camera|cam|more|it"),
    ("sexual", 1.0, "undress|strip|undresses|strips|masturbate|masturbating|naked on|for|in|live camera|cam|webcam"),
    ("sexual", 0.4, "from ANY coins|dollars|euros|credits|tokens a|per minute|hour"),
    ("sexual", 1.0, "full|new|free|leaked|hot nude|naked|nudes set|pics|photos|clips|video|album|gallery"),
    ("sexual", 1.0, "my|your naked|nude body"),
    ("sexual", 0.6, "what|things you|i would|want|will to? do to my|your body|TITS|ANY? body"),
    ("sexual", 1.0, "LUST LUST? DATES ANY? LUST|RAW"),
    ("sexual", 0.4, "all night|click LUST? now|click|here"),
    ("sexual", 0.9, "videos|vídeos|fotos|films|film|vidéos|photos porno|pornô|xxx|pornos|porn"),
    ("sexual", 1.0, "LUST? DATES reife|maduras|mûres|nuas|desnudas|nues|LUST LUST? ANY"),
    ("sexual", 0.5, "DATES maduras|nuas|desnudas|nues|mûres"),
    ("report", 0.0, "SAY"),
    ("own", 0.0, "i|we|ich|yo|eu|je SAY"),
    ("own", 0.0, "whoever|anyone|everyone|you who? SAY"),
    ("threat", 0.2, "someone|somebody should|must|ought"),
    ("threat", 0.5, "someone|somebody please|should|must|ought to? KILL|MAIM @victim"),
    ("threat", 0.8, "up|off and? die"),
    ("threat", 0.5, "may|let cancer|aids|death take|get|strike|find @you"),
]

_KINDS = ("insult", "threat", "dehumanise", "sexual")
#: Classes of words that people disguise.
_DISGUISED = ("INSULT", "SLUR", "ADJ", "BEAST", "SEX", "LUST", "MILD", "TITS")
#: Classes in which a typing error is looked for.
_MISTYPED = ("INSULT", "ADJ", "SEX", "BEAST", "LUST")
#: States or symbols that are kept; the automaton is determinised afresh beyond that.
KEPT = 100_000

# Letters of other scripts that look like Latin ones. Fixed values.
_ALIKE = str.maketrans("аеорсухіјѕԁһӏвкмнтгАЕОРСУХІЈЅВКМНТαορτυνικε", "aeopcyxijsdhlbkmhtrAEOPCYXIJSBKMHTaoptuvike")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e"})
_INVISIBLE = re.compile("[­​-‏‪-‮⁠⁦-⁩﻿]")
_TAG = re.compile(r"<[^<>]{1,200}>|&(?:nbsp|amp|quot|lt|gt|#\d+);")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_] ){2,}[^\W_](?![^\W_])")
_END = re.compile(r"[.!?。！？…\n🤷🙄]")
_CHUNK = re.compile(r"\S+|\n")
_BLANKS = re.compile(r"[^\S\n ]|(?<= ) +")
# A quotation opens after a blank and before a letter, and closes in the same paragraph after a character and before a blank or a mark.
_QUOTED = re.compile(r"(?<![^\s(\[>:])[\"“„«](?=\S)[^\"“”„«»\n]*(?<=\S)[\"“”»](?!\w)")
_OPEN, _CLOSE = "([{<\"'“”„«»‘’*_~#", ")]}>\"'“”„«»‘’,:;.!?…*_~"
# Common words one edit away from the lexicon. Fixed values.
_COMMON = set("""itch hitch ditch pitch witch batch botch butch while whole where shore chore store score horse whose white morons moon boron mormon idiom
    pathetically disgustingly worth stupor cretan bastards custard mustard trashy porn pork pawn corn worn horn born torn port pore sec set six sax stripe strips trip stripped naked baked
    nuke node nuder rude dude nudge orgy pig big dig cunning hunt punt cunts pricky trick brick salad salads salut salaun abri ordre border order babaco barata barato barça salope escort escorte resort effort
    animal animals animaux penis bottom kill kills skill hill bill will mill till parasol idiote cretine vermine vermin vermont permit ratatouille imbecil salaire mercado mierdas pierda miedo miel media tierra sierra
    wanted wander hardcover explicit explicitly implicit steady steam horny thorny corny kinky pinky slut slot slit dirty thirty dirt foul pool tool fools cool coward toward cowards forward filth fifth filthy guilty healthy wealthy losers loser closer laser
    closers users liars garbage cabbage clown crown brown swine twine wine spine shine coat goat trottel trottoir schwein schwerin canale canal canalha canalla cabrones carbones cabron carbon putas pubs wicked dumb thumb numb vile mile file bile
    scum slum sum scam drum cum sick fat dogs beasts feasts lice leeches speeches beaches""".split())  # fmt: skip


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("ß", "ss")


def _is_class(label: str) -> bool:
    return label.rstrip("^").isupper()


class Automaton:
    """Union of rules over symbols, composed of phrases and determinised lazily; outputs (rule, weight) at their ends."""

    def __init__(self, clauses: list[tuple[str, float, str]], phrases: dict[str, list[str]]):
        self.kinds = [kind for kind, _, _ in clauses]
        self.phrases = {name: [(float(a.split(" ", 1)[0]), a.split(" ", 1)[1].split()) for a in alternatives] for name, alternatives in phrases.items()}
        self.steps: list[list[tuple[frozenset, int]]] = [[]]
        self.final: dict[int, tuple[int, float]] = {}
        self.vocabulary: set[str] = set()
        for rule, (_, weight, text) in enumerate(clauses):
            for state, total in self._sequence(text.split(), {0: weight}).items():
                if state:
                    self.final[state] = (rule, round(total, 6))
        self.forget()

    def forget(self) -> None:
        """Drops the determinised part."""
        self.states = {frozenset([0]): 0}
        self.sets = [frozenset([0])]
        self.table: list[dict] = [{}]
        self.outputs: list[tuple] = [()]

    def _sequence(self, elements: list[str], here: dict[int, float]) -> dict[int, float]:
        """States after a sequence, with the weights of the paths to them."""
        for element in elements:
            mark = element[-1] if element[-1] in "?*" and len(element) > 1 else ""
            options = (element[:-1] if mark else element).split("|")
            reached = dict(here) if mark else {}
            for _ in range(3 if mark == "*" else 1):
                here = self._one(options, here)
                for state, weight in here.items():
                    reached[state] = weight
            here = reached
        return here

    def _one(self, options: list[str], here: dict[int, float]) -> dict[int, float]:
        out: dict[int, float] = {}
        for name in (o[1:] for o in options if o[0] == "@"):
            for weight, elements in self.phrases[name]:
                out |= self._sequence(elements, {s: w + weight for s, w in here.items()})
        labels = frozenset(o if _is_class(o) else _plain(o) for o in options if o[0] != "@")
        if labels:
            self.vocabulary |= {x for x in labels if not _is_class(x)}
            for weight in set(here.values()):
                new = len(self.steps)
                self.steps.append([])
                for state, w in here.items():
                    if w == weight:
                        self.steps[state].append((labels, new))
                out[new] = weight
        return out

    def step(self, state: int, symbol: frozenset) -> int:
        """The state after a symbol, a set of labels; a rule may begin at any token."""
        found = self.table[state].get(symbol)
        if found is None:
            after = frozenset([0] + [target for s in self.sets[state] for labels, target in self.steps[s] if "ANY" in labels or not labels.isdisjoint(symbol)])
            found = self.states.get(after)
            if found is None:
                found = self.states[after] = len(self.sets)
                self.sets.append(after)
                self.table.append({})
                best: dict[int, float] = {}
                for s in after:
                    if s in self.final:
                        rule, weight = self.final[s]
                        best[rule] = weight if rule not in best else max(best[rule], weight, key=abs) if min(best[rule], weight) < 0 else max(best[rule], weight)
                self.outputs.append(tuple(best.items()))
            self.table[state][symbol] = found
        return found


class Speller:
    """Written token to the symbol of the word it stands for."""

    def __init__(self, vocabulary: set[str]):
        self.classes: dict[str, set[str]] = {}
        for name, words in LEXICON.items():
            for word in words.split():
                self.classes.setdefault(_plain(word), set()).add(name)
        self.disguised = {w for w, names in self.classes.items() if not names.isdisjoint(_DISGUISED)}
        self.vocabulary = vocabulary
        self.errors: dict[str, str] = {}
        letters = "abcdefghijklmnopqrstuvwxyz"
        for word in sorted(self.disguised, key=len):
            if len(word) < 5 or "-" in word or self.classes[word].isdisjoint(_MISTYPED):
                continue
            cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
            variants = [a + b[1:] for a, b in cuts if b] + [a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1] + [a + b[0] + b for a, b in cuts if b]
            if len(word) > 5:
                variants += [a + c + b[1:] for a, b in cuts if b for c in letters] + [a + c + b for a, b in cuts for c in letters]
            for v in variants:
                if v not in self.classes and v not in _COMMON and v not in vocabulary and len(v) > 3:
                    self.errors.setdefault(v, word)
        self.by_length: dict[int, list[str]] = {}
        for word in sorted(self.disguised):
            self.by_length.setdefault(len(word), []).append(word)
        self.symbols: dict[str, frozenset] = {}
        self.chunks: dict[str, tuple] = {}

    def word(self, token: str) -> str | None:
        """The word of the lexicon or the grammar that a token without its outer punctuation is, if any."""
        plain = _plain(token.translate(_ALIKE).lower() if any(c.isalpha() and ord(c) < 128 for c in token) or not token.isascii() else token.lower())
        if plain in self.classes or plain in self.vocabulary:
            return plain
        if "*" in plain and len(plain) < 20:
            shape = re.compile("".join("[a-z]" if c == "*" else re.escape(c) for c in plain) + "$")
            return next((w for w in self.by_length.get(len(plain), ()) if shape.match(w)), None)
        joined = re.sub(r"(?<=\w)[-._·|/](?=\w)", "", plain) if re.fullmatch(r"(?:\w[-._·|/])+\w", plain) else plain
        for form in dict.fromkeys([joined, joined.translate(_LEET), joined.replace("1", "l").translate(_LEET)]):
            if form != joined and not any(c.isalpha() for c in joined) and len(joined) < 5:
                continue
            for candidate in dict.fromkeys([form, re.sub(r"(.)\1{2,}", r"\1", form), re.sub(r"(.)\1+", r"\1", form)]):
                if candidate in self.disguised:
                    return candidate
                if candidate in self.errors:
                    return self.errors[candidate]
        return None

    def symbol(self, token: str) -> frozenset:
        """Labels of a token: its word, its classes, CAP for a capital first letter."""
        found = self.symbols.get(token)
        if found is None:
            labels = set()
            word = self.word(token)
            if word is not None:
                labels |= self.classes.get(word, set())
                if word in self.vocabulary:
                    labels.add(word)
            if token[:1].isupper():
                labels.add("CAP")
            if len(self.symbols) > KEPT:
                self.symbols.clear()
            found = self.symbols[token] = frozenset(labels)
        return found

    def chunk(self, chunk: str) -> tuple:
        """(symbols, symbols at the beginning of a sentence, end of a sentence, end of a clause) of what stands between blanks."""
        found = self.chunks.get(chunk)
        if found is None:
            token = chunk.strip(_OPEN + _CLOSE) or chunk
            inner = chunk.rstrip(_CLOSE) if "*" not in chunk else chunk.rstrip(_CLOSE.replace("*", ""))
            if "*" in chunk:
                token = inner.lstrip(_OPEN.replace("*", ""))
            parts = [token]
            if ("-" in token or "'" in token or "’" in token or "/" in token) and not self.symbol(token) - {"CAP"}:
                parts = [p for p in re.split(r"[-'’/]", token) if p] or parts
            elif not token[-1:].isalnum():
                parts = [token.rstrip("!")]
            symbols = tuple(self.symbol(p) for p in parts)
            first = tuple(frozenset({"INIT" if x == "CAP" else x for x in s} | {x + "^" for x in s if x in LEXICON}) if not i else s for i, s in enumerate(symbols))
            tail = chunk[len(inner) :]
            if len(self.chunks) > KEPT:
                self.chunks.clear()
            found = self.chunks[chunk] = (symbols, first, bool(_END.search(tail) or _END.search(chunk[-1:])), ";" in tail)
        return found


@lru_cache(maxsize=1)
def _machine() -> tuple[Automaton, Speller]:
    automaton = Automaton(CLAUSES, PHRASES)
    return automaton, Speller(automaton.vocabulary)


def score_text(text: str | None) -> tuple[float, list[str]]:
    """(score, kinds): the score of the most abusive sentence of a text, and what kinds of abuse reach the threshold.

    A sentence scores the sum of the weights of the rules that match in it. What stands between quotation marks (an opening and a closing
    one in one paragraph) says nothing; a rule in the scope of reported speech, the rest of its clause, keeps the share
    REPORTED of its weight. Null, empty and blank texts score 0. The whole text is read.
    """
    if not text:
        return 0.0, []
    automaton, speller = _machine()
    if len(automaton.sets) > KEPT:
        automaton.forget()
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    text = _QUOTED.sub(" , ", _TAG.sub(" ", text))
    text = _SPACED.sub(lambda m: m.group(0).replace(" ", ""), _BLANKS.sub(" ", text))
    table, step, outputs, chunks, rule_kinds = automaton.table, automaton.step, automaton.outputs, speller.chunks, automaton.kinds
    best, kinds = 0.0, set()
    state, held, reported, fresh = 0, {}, False, True
    for chunk in _CHUNK.findall(text):
        if chunk != "\n":
            known = chunks.get(chunk) or speller.chunk(chunk)
            for symbol in known[1] if fresh else known[0]:
                if not state and not symbol:
                    continue
                after = table[state].get(symbol)
                state = step(state, symbol) if after is None else after
                for rule, weight in outputs[state]:
                    kind = rule_kinds[rule]
                    if kind == "report":
                        reported = True
                    elif kind == "own":
                        reported = False
                    else:
                        weight *= REPORTED if reported and weight > 0 else 1.0
                        if rule not in held or abs(weight) > abs(held[rule]):
                            held[rule] = weight
            fresh = False
            if known[3]:
                reported = False
            if not known[2]:
                continue
        if held:
            total = sum(held.values())
            if total >= THRESHOLD - 1e-9:
                kinds |= {rule_kinds[r] for r, w in held.items() if w >= 0.3}
            best = max(best, total)
            held = {}
        state, reported, fresh = 0, False, True
    if held:
        total = sum(held.values())
        if total >= THRESHOLD - 1e-9:
            kinds |= {rule_kinds[r] for r, w in held.items() if w >= 0.3}
        best = max(best, total)
    return round(best, 6), sorted(kinds)


def score_documents(df: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """``key``, the columns ``keep``, ``score`` and ``kinds`` of every row; rows are kept one to one.

    Other columns are ignored, whatever their names; nulls anywhere are allowed.
    """
    names = [key, *(keep or [])]
    slim = df.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)], F.col(text).alias("__text"))
    schema = ", ".join(f"c{i} {df.schema[n].dataType.simpleString()}" for i, n in enumerate(names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = [score_text(t) for t in batch.pop("__text")]
            yield batch.assign(score=[s for s, _ in scored], kinds=[k for _, k in scored])

    found = slim.mapInPandas(run, schema + ", score double, kinds array<string>")
    return found.withColumnsRenamed({f"c{i}": n for i, n in enumerate(names)})


def rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per source (null is one) documents, abusive documents and their share."""
    flagged = F.count_if(F.col("score") >= threshold)
    return scored.groupBy(source).agg(F.count(F.lit(1)).alias("n_documents"), flagged.alias("n_abusive"), F.round(flagged / F.count(F.lit(1)), 6).alias("rate"))
