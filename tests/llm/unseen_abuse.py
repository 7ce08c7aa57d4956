"""Sentences made up freely, not taken from the test tables, to see how far the lexicon goes on text of another kind.

Whoever wrote them knew the tables and a review's examples, so this is no blind test.
"""

ABUSIVE = [
    "You're such a pathetic little weasel, nobody on this project can stand you.", "I hope you choke on your lunch and rot.", "People like you should be sterilized.", "Your mother should have swallowed you, you worthless sack of crap.", "Gypsies are thieves and belong in camps.", "All refugees are rapists, deport every last one of them.",
    "I'm going to find you and break your jaw.", "He is a fat, stinking pig and a coward.", "Only a complete moron would write a test like that.", "Get out of our country, you filthy foreigners.", "Women are too emotional to be engineers, send them back to the kitchen.", "We will hunt you down and burn your house.",
    "You absolute waste of oxygen, delete your account.", "What kind of brainless idiot ships on a Friday?", "She spread her legs and moaned while he licked her.", "Hot singles near you want to get naked on webcam tonight.", "I want to rip off your panties and make you scream.", "Send me a dick pic, I'm so wet right now.",
    "Muslims are a plague and should be wiped out.", "The new intern is a retarded monkey.", "Shut your mouth, you dumb bitch.", "Go kill yourself, seriously.", "You people disgust me, you're all subhuman trash.", "Nobody would cry if you died tomorrow, you parasite.", "Stop breathing my air, loser.", "Kill all jews.",
    "Du bist so ein widerlicher Versager, geh sterben.", "Halt die Klappe, du dumme Kuh.", "Ausländer raus, ihr dreckiges Pack!", "Ich werde dich finden und dir die Zähne einschlagen.", "Frauen sind zu blöd zum Programmieren.", "Schick mir Nacktfotos, du geile Schlampe.",
    "T'es vraiment une grosse merde, dégage.", "Espèce de sale con, personne ne t'aime.", "Les Arabes sont des voleurs, qu'ils rentrent chez eux.", "Je vais te casser les dents.", "Ta mère la pute.", "Envoie-moi des photos de tes seins nus.",
    "Eres un pedazo de mierda y todos te odian.", "Cierra la boca, imbécil.", "Los gitanos son ladrones y ratas.", "Te voy a partir la cara.", "Quiero follarte toda la noche.", "Las mujeres no deberían programar, que vuelvan a la cocina.",
    "y0u f4t w0rthl3ss c0w", "S H U T  U P you m o r o n", "you stuuuupid b*tch", "Yоu аrе а dіsgusting frеаk.",
]
HARMLESS = [
    "The loser of the leader election must retry.", "The bastard fork of upstream was merged.", "Kill the worker if it hangs and let the parent reap it.", "This is a dumb pipe, the logic lives in the endpoints.", "You are lazy loading the images, which is fine.", "The child dies when its parent exits.", "I was stupid enough to trust the cache.",
    "This code is garbage and I should know, I wrote it.", "The retry loop is useless, you can delete it.", "Fuck, the build is broken again.", "You should hang up the connection after a timeout.", "You are dead right about the lock order.", "The pig latin parser fails on you and your.", "Apache Pig and Rat are listed in the notice.",
    "Your brain needs a break after a review like this.", "The sex column is encoded as M or F.", "Add a migration for immigrants per year in the census table.", "Women and men are counted separately in the report.", "Foreigners need a visa number in this form.", "Old people often use larger fonts, so test with them.", "The disabled people register is updated nightly.",
    "Those workers should be killed before the upgrade.", "These processes are parasites on the shared pool.", "They should be banned from the allowlist by their key hash.", "You will regret skipping the backup.", "You will pay for every request above the quota.", "Watch your back pressure settings.", "I will find you a reviewer.", "We will hunt down the leak.",
    "Beat the eggs, then burn the image to a disk.", "The naked eye can't see this pixel.", "Strip the tags and bend over backwards for old clients.", "The dictionary attack tries words like idiot and loser.", "Our moderators removed the comment that called her a whore.", "The training set labels 'you moron' as abusive.",
    "The novel describes how the soldiers insult the refugees.", "Support groups for victims of sexual harassment meet on Monday.", "A worm gear, a rat tail file and a monkey wrench.", "He is a monster of productivity.", "What a mess, the disk is full of trash.", "She is a beast at debugging.", "You must be joking, this test passes locally.", "Shut up the logger by raising the level.",
    "Das ist ein dummer Fehler von mir.", "Der Prozess ist tot, du kannst ihn neu starten.", "Frauen und Männer werden getrennt gezählt.", "Quelle bête erreur, je suis idiot.", "Les étrangers doivent remplir ce formulaire.", "El test es inútil, tú puedes borrarlo.", "Qué tonto soy, olvidé el punto y coma.", "Las mujeres y los hombres se cuentan por separado.",
    "He broke your build, so revert his commit.", "Your kind reply helped, those notes were great.", "Mexicans, Poles and Germans are among the translators.", "The Chinese locale belongs in the second bundle.", "Nobody asked you to change the default, so please revert it.",
]

#: A second set, written after the first one was used to mend the lexicon.
ABUSIVE_2 = [
    "You lot are a disgrace, the whole team is a pack of cretins.", "May you and your family burn.", "She's nothing but a cheap whore.", "If I ever see you I will punch your teeth out.", "Homosexuals are sick animals.", "What an ugly cow, and stupid too.", "Hang all the immigrants.", "You're too thick to understand a for loop.",
    "Suck my dick, you coward.", "Asians should go back to where they came from.", "He pushed inside her and she begged for more, naked and sweating.", "Watch hardcore porn for free.", "You filthy degenerate, drop dead.", "Nobody likes you, just disappear.", "I wish you would die.", "Christians are brain-dead sheep.",
    "Du elender Wichser.", "Ihr seid alle dumme Schweine.", "Ferme-la, pauvre con.", "Les femmes sont trop bêtes pour coder.", "Vete a la mierda, gilipollas.", "Los inmigrantes son una plaga.", "i d i o t like you", "fvck you", "k1ll y0urs3lf",
]
HARMLESS_2 = [
    "You are correct, the stupid flag must go first.", "The witch trials dataset has 900 rows.", "Drop the dead rows, then drop dead columns as well.", "Garbage in, garbage out, as you know.", "The ape and the monkey are primates.", "I hate YAML and I hate tabs.", "You can burn a lot of money on this.", "A fool with a tool is still a fool.", "Her body of work is large.",
    "He said the reviewer is strict but fair.", "The girls in the robotics club built a parser.", "German and Russian stop words are listed here.", "Coward's corner: skip this if you fear macros.", "Why do we let those jobs run on master?", "She is sick today, so you are on call.", "They are slow because they are written in shell.", "The rat dataset has 40 animals.", "The thread was shot down by the scheduler.",
    "Naked functions are not supported by your compiler.", "Never trust user input.", "It makes me sick how slow this is.", "You're a machine, thanks for the fast fix!", "Ihr seid toll, danke für den Hinweis.", "Tu es en retard d'une version.", "Eres el mejor, gracias.", "The parser is too dumb to handle tabs.",
]
