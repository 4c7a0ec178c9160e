"""Sentences in wordings of our own. The first three sets were read while the grammar was widened; LAST was written when it was finished."""

ABUSIVE = [
    "You are a complete waste of oxygen and everyone at work knows it.", "These people should all be killed.", "Women should be raped.", "You're such a pathetic loser, honestly.", "Nobody would notice if you disappeared, you useless freak.",
    "I swear I'm going to stab you in your sleep.", "All immigrants are parasites.", "Gas the Jews.", "Go kill yourself already.", "What kind of retarded clown writes this garbage?", "Your mother is a whore.", "That filthy gypsy trash needs to be burned out of here.",
    "We're going to rape your daughter and make you watch.", "These savages are not human.", "You dumb bitch, get back in the kitchen.", "Refugees are nothing but vermin.", "I hope your kids die of cancer.", "Someone please put a bullet in his head.",
    "He's a fat disgusting pig and so is his wife.", "Send me nudes, baby.", "Watch hot teens fucking on live webcam, click here.", "My cock is hard, come and suck it.", "Those people breed like rats and should be sterilised.", "I know where your children go to school, watch your back.",
    "They deserve to be hanged from the lampposts.", "Anyone who voted for this is a brainless sheep.", "Kill all muslims.", "Drown the migrants.", "You people make me sick, you are scum.", "Shut your mouth, you ugly cow.", "She is a dirty slut who sleeps with everyone.",
    "Faggots like you should burn.", "The world would be better off without you.", "If you come here again I'll break every bone in your body.", "You're too stupid to breathe.", "The Romani are thieves and animals.", "I will slit your throat.", "Every single one of them ought to be shot.",
    "You have the intelligence of a rotten potato.", "Free hardcore porn videos, join now.", "Get out of our country, you parasites.", "You absolute moron.", "The minister is a lying, corrupt piece of garbage.", "Horny housewives in your area want sex tonight.", "Blacks are apes.", "Watch out, your house will burn tonight with you inside.",
    "Women are too stupid to drive.", "Du bist so ein Idiot.", "Ausländer sind Abschaum.", "Eres una puta asquerosa.", "Los inmigrantes son parásitos.", "Você é um idiota.", "Tu es une ordure.", "Les étrangers sont des parasites.", "Verpiss dich, du Wichser.", "Te voy a matar.",
]
HARMLESS = [
    "Those rats spread the plague in 1348.", "We will break your parcel into two shipments.", "Nobody deserves to die.", "The villagers should be moved to safety before the flood.", "All families should be evacuated by noon.", "He said that the suspect had threatened to kill her.",
    "Police charged a man who wrote \"you are all vermin\" on a wall.", "Cholera is a disease that spreads through dirty water.", "Dogs are animals that need daily walks.", "I will kill the lights at ten.", "We beat them 3-1 on Sunday.", "The team crushed their rivals.", "I'm dying of laughter.",
    "You are a great neighbour and I am grateful.", "You are wrong about the map.", "Your opinion matters to us.", "The storm will kill crops across the valley.", "Hunters shot two wild pigs near the river.", "The burning of Jews in the Middle Ages is described in chapter four.", "Sex education in schools was extended.",
    "The clinic treats victims of rape and torture.", "The nude in the painting is by an unknown artist.", "Naked mole rats live in colonies.", "Immigrants are often the first to help.", "The refugees need food and matches for their stoves.", "People should not be killed for their faith.", "Pest control removed the cockroaches.",
    "This is a stupid mistake in the timetable.", "The cat is a lazy animal.", "Do not let people drown.", "He was called an idiot by the opposition, the paper reported.", "The report counts threats such as \"I will burn your house\".", "The parasite is carried by snails.",
    "Kill the process and restart the server.", "I'm a fool for chocolate.", "The joke is on us.", "The porn industry faces new rules.", "The strip of land near the harbour is wet.", "The hot singles chart has a new number one.", "I hope they get home safely.", "You will pay for parking at the gate.", "I'll shoot you an email tomorrow.",
    "She is not a liar.", "You are not stupid, you just need practice.", "What a beautiful bunch of flowers.", "They are looking for couples to adopt children.", "The donkey carried the water.", "Many refugees were killed when the boat sank.", "The minister must be held to account.", "A good teacher is one that listens.",
    "The women have to walk back home in the dark.", "Throw the rubbish out before it attracts rats.", "The answer to the housing question is simple.", "Send me the photos of the damage.", "I would like to see you at the meeting.", "Residents burned wood to keep warm.", "Der Hund ist ein treues Tier.", "Los animales son rescatados.", "As baratas foram eliminadas.", "Les rats sont nombreux dans le port.",
]
MORE_ABUSIVE = [
    "Somebody ought to strangle that woman.", "Go hang yourself, nobody would care.", "Your sister is a cheap whore and your dad is a drunk idiot.", "You brainless cow, learn to read.", "We should deport every last one of these leeches.", "The refugees are a cancer on our society.", "I'm gonna beat you to a pulp.",
    "You are nothing, you worthless sack of shit.", "Muslims should be banned and their mosques burned.", "Show us your tits.", "Stupid bitch, who let you write for a newspaper?", "I hope you get raped.", "Those monkeys should go back to Africa.", "He is an imbecile and a coward.", "Hang the traitors, every one of them!",
    "You are the dumbest person I have ever met.", "Gays are an abomination and should be stoned to death.", "Everyone in that village is inbred scum.", "Burn in hell, all of you.", "Looking for a slut to fuck tonight in Rome, message me.", "Exterminate these parasites.", "You're a disgrace to your family.", "May you and your children rot.",
    "You fat ugly loser, nobody wants you.", "Hot naked girls live on cam, free sign-up.", "If I ever see you, I will smash your face in.", "Jews control everything, they are rats.", "What an absolute cretin this author is.", "I want to lick your pussy.", "You deserve to be shot.", "The mayor is a whore.", "Foreigners are stealing rats, kick them out!",
    "I'd love to see those people drown.", "Shut up, retard.", "Cripples are useless and should be put down.", "Du dumme Schlampe.", "Die Flüchtlinge sind Ungeziefer.", "Ojalá te mueras.", "Sois unos imbéciles.", "Vai tomar no cu, seu otário.", "Ferme ta gueule, connard.", "Les juifs sont de la vermine.",
]
MORE_HARMLESS = [
    "The hurricane will kill the power for days.", "She beat cancer twice.", "They should be given shelter at once.", "The court sentenced the man who raped a tourist.", "Farmers burned the infected cattle.", "You deserve a break.", "You are the best neighbours one could ask for.", "The women were killed by the landslide.",
    "All people must leave the building.", "The refugees were hungry, sick and tired.", "I hope you recover soon.", "Watch your step on the icy bridge.", "The dirty water makes people sick.", "His brother is a fisherman and a liar, said the neighbour.", "The rats left the ship.", "It would be a shame if the museum closed.", "Burn the old leaves.",
    "The suspect said \"I will kill you\" before he fled.", "My dog is a lazy pig.", "Slaughter of pigs will begin on Monday.", "A naked man was rescued from the river.", "The video of the rescue is online, click here.", "Women like her are good at many things.", "You will never walk alone.", "Shoot the video in daylight.", "Pornography laws were debated in parliament.",
    "The wet season in the lowlands is hot.", "Hate crimes against Muslims rose by a tenth.", "The Nazis murdered millions of Jews.", "The dam broke its banks.", "Ugly weather, stupid forecast.", "The volunteers are animals when it comes to work, in the best sense.", "We are hunting the cause of the blackout.", "The Smiths are farmers.", "Fire destroyed your house?",
    "He threatened to break the strike.", "The doctor will see you now.", "Nobody would wish that on anyone.", "You can't kill an idea.", "They were told to go home.", "The people need guns to hunt in winter.", "Die Kinder sind müde.", "Los niños son felices.", "Les enfants sont sages.",
]
THIRD_ABUSIVE = [
    "You should be ashamed of being alive, you parasite.", "Kick the filthy foreigners out of our town.", "Your face looks like a pig's arse, you moron.", "One day I will find you and cut your throat.", "She's nothing but a cheap slut.", "Old people are useless parasites.", "You're a joke and a coward.",
    "Let the refugees drown.", "The only good terrorist lover is a dead one, you traitor scum.", "Trans people are freaks.", "I am going to kill your whole family.", "You're an idiot if you believe this.", "What a bunch of lying rats you are.", "Sexy teens nude pics, click here.", "I want to fuck you so hard.",
    "Christians are vermin.", "Nobody likes you, you ugly freak.", "Politicians are all criminals and should be hanged.", "This author is a brain-dead imbecile.", "Get lost, you dirty beggar scum.", "You will die soon, we know where you live.", "That stupid whore from the council lied again.", "I hope the whole lot of them burns.",
    "You pathetic excuse for a man.", "Men like you should be castrated.", "The gypsies are stealing animals.", "Drop dead, moron.", "Go back to your own country, savages.", "They are subhuman filth.", "Send nudes and I will send mine.", "Dirty immigrants bring disease.", "Ihr seid alle Abschaum.", "Muérete, cabrón.", "Vous êtes des ordures.", "Seus idiotas imundos.",
]
THIRD_HARMLESS = [
    "Rescue dogs found the boy alive.", "The company will cut your bill in half.", "You are under no obligation.", "The mother of the victim is a nurse.", "Critics called the plan stupid.", "The disease killed thousands of pigs.", "I could murder a sandwich.", "The cows were moved before the flood.", "Women and children were evacuated first.",
    "The trash was collected late.", "They hit the road at noon.", "The people deserve better roads.", "An animal was hit by a train.", "Kill switches were installed in the plant.", "The boss is a good man.", "A liar would say that.", "We will beat this virus together.", "Every family should be given a tent.", "The killers were hanged in 1921.",
    "I hate mosquitoes.", "The committee condemned calls to deport migrants.", "Hot weather and wet ground.", "The film shows a nude scene.", "Adults only swim at nine.", "The village idiot is a character in the play.", "You look like your brother.", "Do you want to trade stamps?", "The rat is a rodent.", "This app is garbage.", "My phone died.", "Their children go to school in town.",
    "Migrants were found dead in a truck.", "He shot three clay pigeons.", "They are fighting for their lives.", "Die Ratten sind im Keller.", "La casa es vieja.",
]
LAST_ABUSIVE = [
    "Only a complete imbecile could write such a report.", "I'll rip your head off.", "You filthy liar, may you rot.", "Nobody needs these parasites here, ship them home.", "Immigrants breed like rabbits.", "That judge is a corrupt old bastard.", "You are so dumb it hurts.", "Women belong in the kitchen, you stupid cow.", "I want these people dead.",
    "Someone should shoot the governor.", "Lesbians are disgusting.", "We will hang you from the bridge.", "Shut up and die.", "You smell like a sewer, you tramp.", "The journalists are whores.", "Hot wives waiting for sex, chat now.", "Watch me undress on webcam.", "You're a worthless piece of trash.", "Arabs are dogs.", "Every immigrant is a criminal.",
    "Fuck you and your family.", "May cancer take you.", "You clowns have no brains.", "What an ugly, stupid face you have.", "Deport the lot, they are pests.", "He deserves a bullet.", "You are vermin and should be gassed.", "Who let this retard speak?", "Ich bringe dich um.", "Callaos, hijos de puta.",
]
LAST_HARMLESS = [
    "You are so kind.", "The shop sells rope and gas.", "The bridge will be destroyed in May.", "Police shot the attacker.", "These people are heroes.", "Rabbits breed quickly.", "He is a clown in the circus.", "The dog bit the mayor.", "Patients with cancer need care.", "The kitchen belongs to the hotel.", "Tramps slept in the station.", "The governor should resign.",
    "I want these people home safely.", "Her head hurts.", "Journalists are underpaid.", "Wives waited at the port.", "A bullet was found in the wall.", "The pests destroyed the harvest.", "Who let the dogs out?", "Your family is welcome.", "She undressed the wound.", "The camp is full of rats.", "He hates liars.", "The people of the valley are poor.", "Stop the killing.",
    "We found the body of the missing man.", "Die Lage ist dumm gelaufen.", "Los perros duermen.", "It was the worst day of my life.", "The bastard file is a woodworking tool.",
]
