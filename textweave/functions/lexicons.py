"""Word and phrase lists, and the patterns of single-sentence marks.

Fixed values: results depend on each of them; they are stated in their natural order.
"""

from __future__ import annotations

# Fixed values from here to the end of the file.

AUXILIARY_VERBS = (
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
)

MODAL_VERBS = (
    "will", "would", "shall", "should", "can", "could", "may", "might", "must",
)

BASE_VERBS = (
    "go", "come", "feel", "think", "want", "need", "make", "take", "see", "hear", "say", "get", "know", "tell", "put", "keep", "leave", "bring",
    "work", "sleep", "eat", "drink", "walk", "run", "write", "read", "call", "try", "look", "use", "help", "move", "live", "stay", "start", "stop",
    "plan", "finish", "hope", "wait", "hold", "turn", "open", "close", "learn", "remember", "forget", "ask", "answer", "reply", "find", "lose", "pay",
    "play", "speak", "talk", "sit", "stand", "drive", "ride", "meet", "build", "fix", "change", "check", "focus", "rest", "wake", "grow",
)

IRREGULAR_PAST = (
    "went", "thought", "felt", "knew", "saw", "came", "got", "made", "said", "took", "told", "found", "gave", "left", "put", "read", "ran", "sat",
    "stood", "understood", "wrote", "began", "broke", "chose", "spoke", "woke", "drove", "ate", "fell", "forgot", "grew", "hid", "held", "kept",
    "led", "lost", "met", "paid", "sent", "set", "shot", "showed", "shut", "sang", "slept", "spent", "spread", "taught", "threw", "wore", "won",
    "meant", "heard", "brought", "caught", "bought", "built", "dealt", "hung", "laid", "let", "lit", "rose", "shook", "shone", "sank", "spun",
    "split", "stuck", "stung", "struck", "swam", "swung", "tore", "wound", "became", "bit", "blew", "drew", "flew", "froze", "hurt", "knelt", "rang",
    "rode", "sought", "slid", "sold", "sprang", "stole", "swept", "wept",
)

THIRD_PERSON_VERBS = (
    "thinks", "knows", "feels", "wants", "needs", "understands", "believes", "seems", "appears", "works", "helps", "makes", "takes", "gives", "says",
    "tells", "asks", "looks", "finds", "uses", "shows", "tries", "means", "keeps", "lets", "begins", "becomes", "remains", "provides", "requires",
    "includes", "allows", "suggests", "considers", "expects", "creates", "offers", "produces", "serves", "represents", "supports", "contains",
    "involves", "continues", "follows", "leads", "gets", "puts", "sits", "stands", "runs", "comes", "sees", "hears", "talks", "walks", "plays",
    "stays", "calls", "turns", "holds", "brings", "writes", "reads", "learns", "remembers", "forgets", "likes", "loves", "hates", "cares", "matters",
    "happens", "exists", "lives", "dies", "starts", "stops", "ends", "sleeps", "eats", "drinks", "speaks", "breaks", "falls", "grows", "pays",
    "sends", "spends", "meets",
)

VERB_SUFFIXES = ("ed", "ing", "es")

TEMPORAL_MARKERS = (
    "today", "yesterday", "tomorrow", "this morning", "this afternoon", "this evening", "tonight", "later", "later on", "earlier", "earlier today",
    "after", "afterwards", "before", "then", "when", "while", "now", "right now", "recently", "lately", "these days", "last night", "last week",
    "last month", "last year", "next week", "next month", "next year", "at the time", "at first", "in the end", "eventually", "the other day",
)

PAST_MARKERS = (
    "yesterday", "earlier", "earlier today", "last night", "last week", "last month", "last year",
)

FUTURE_MARKERS = (
    "tomorrow", "later", "later on", "next week", "next month", "next year", "soon",
)

GLUE_CONNECTORS = (
    "because", "so", "but", "then", "after", "before", "when", "while",
)

CONNECTORS = (
    "because", "so", "but", "however", "although", "though", "therefore", "then", "after", "before", "instead", "still", "yet", "also", "meanwhile",
    "finally", "nevertheless", "regardless", "otherwise", "despite", "as a result",
)

REFLECTION_PHRASES = (
    "i realized that", "i realized how", "i realized why", "i realized what", "now i realize", "i've realized", "made me realize",
    "i've learned that", "i learned that", "i've learned to", "i learned to", "taught me that", "taught me about", "taught me a lot",
    "taught me so much", "i see now", "now i see", "i see where i", "i see why", "starting to understand myself", "starting to understand why",
    "starting to understand how", "starting to see myself", "starting to see why", "starting to see how", "beginning to see myself",
    "beginning to see why", "beginning to see how", "beginning to understand myself", "beginning to understand why", "beginning to understand how",
    "i've grown", "i've come to", "i've been thinking", "i've changed", "i've noticed that i", "i've noticed how i", "i've noticed my",
    "it made me think", "helped me understand", "helped me see", "i understand now", "now i understand", "in hindsight", "upon reflection",
    "time to reflect", "looking back,", "looking back at my", "looking back on", "i used to think", "i used to believe", "i used to be",
    "i was so certain", "i was afraid of", "i was wrong about", "gave me perspective", "given me perspective", "put things in perspective",
    "puts things in perspective", "opened my eyes", "it hit me that", "it clicked", "it dawned on me", "something changed in me", "something shifted",
    "changed something in me", "changed me", "i'm finally learning", "finally understand", "my pattern", "my patterns", "what matters is",
    "what's important is", "the point is", "is humbling", "was humbling", "has been humbling", "going forward", "from now on",
)

CLOSURE_CUES = (
    "in the end", "at the end of the day", "all in all", "all things considered", "the bottom line", "the point is", "what matters is",
    "what's important is", "that's enough", "that's okay", "that's alright", "that's fine", "it's okay", "it's alright", "it's fine", "it'll be okay",
    "everything's okay", "everything will be", "i'm okay with", "i'm at peace", "i can accept", "i accept that", "i did it", "i made it", "i got the",
    "i finally", "we did it", "we made it", "from now on", "going forward", "moving forward", "tomorrow i'll", "tomorrow i will", "next time",
    "i'm ready to", "i'm going to", "time to move on", "i'm grateful", "i'm thankful", "grateful for", "thankful for", "that's all for now",
    "enough for now", "enough for today", "good night", "goodnight", "so overall", "overall i", "to sum up", "in summary", "long story short",
    "the takeaway",
)

ABANDONMENT_MARKERS = (
    "what do i do", "what am i supposed to", "what am i going to", "what should i", "what now", "now what", "where do i go", "how do i",
    "why does this", "why do i", "why can't i", "will it ever", "when will", "is it ever going to", "what's the point", "what's wrong with me",
    "i don't even know", "i just don't know", "i have no idea", "who knows", "who cares", "whatever", "i give up", "i can't anymore",
    "i can't do this", "so yeah", "but yeah", "but anyway", "anyway", "idk", "ugh",
)

RESTART_CUES = (
    "anyway", "wait,", "wait!", "wait.", "wait no", "or wait,", "hold on,", "hold on.", "i mean", "no,", "actually", "never mind", "nevermind",
    "scratch that", "just forget it", "ugh forget it", "so yeah", "where was i", "what was i saying", "let me start over",
)

HEDGE_CUES = (
    "maybe", "i guess", "i suppose", "i think", "i'm not sure", "not sure", "i'm unsure", "i don't know", "kind of", "sort of", "probably", "perhaps",
    "possibly", "might be", "who knows", "it feels like",
)

BELIEF_PATTERNS = (
    "i am ", "i'm ", "i feel ", "i'm feeling ", "i feel like ", "i will ", "i'll ", "i won't ", "i can ", "i can't ", "i cannot ", "i could ",
    "i couldn't ", "i always ", "i never ", "i usually ", "i love ", "i hate ", "i want ", "i need ", "i should ", "i shouldn't ", "i must ",
    "i know ", "i believe ", "i think that ", "i'm sure ", "i'm certain ", "i'm confident ", "i'm afraid ", "i'm scared ", "i'm worried ",
    "i'm happy ", "i'm sad ", "i'm angry ",
)

NEGATION_WORDS = (
    "not", "no", "never", "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "cannot", "couldn't", "shouldn't", "isn't", "aren't", "wasn't",
    "weren't", "nothing", "nobody", "nowhere", "none",
)

POLAR_PAIRS = (
    ("confident", "worthless"), ("capable", "incapable"), ("strong", "weak"), ("enough", "inadequate"), ("love", "hate"), ("happy", "sad"), ("hopeful", "hopeless"),
    ("success", "failure"), ("succeed", "fail"), ("certain", "uncertain"), ("sure", "unsure"), ("right", "wrong"), ("good", "bad"), ("connected", "alone"), ("loved", "unloved"),
)

INTEGRATION_MARKERS = (
    "but i've realized", "but i realize", "but now i see", "and yet i see now", "and yet i understand", "both are true", "both can be true",
    "i can hold both", "i can see both", "it's complicated", "it's complex", "it's not that simple", "i used to think", "i used to believe",
    "i used to feel", "now i see", "now i understand", "now i realize", "i've come to see", "i've come to understand", "i've come to realize",
    "at the same time", "on the other hand", "even though", "despite", "although", "nevertheless", "nonetheless", "while also", "i've changed",
    "i've grown", "i've learned", "i'm learning to", "i'm starting to see", "i'm beginning to understand", "looking back", "i can be both",
    "both sides", "makes sense now", "it all makes sense",
)

TOPIC_RESET = ("anyway", "also", "wait", "oh", "speaking of", "unrelated", "side note", "back to", "just remembered", "nevermind", "never mind")
REFERENT_STARTS = ("it", "this", "that", "these", "those", "he", "she", "they", "him", "her", "them", "his", "their", "there", "then")
ANCHOR_WORDS = ("my", "mom", "dad", "friend", "partner", "husband", "wife", "boyfriend", "girlfriend")
SETUP = ("throwaway", "sorry for", "apologies for", "english isn't", "english is not", "mobile", "format", "you'?ll see why", "long story", "for context", "background")
OPEN_ENDINGS = ("i don't know", "idk", "whatever", "anyway", "i won't elaborate", "nothing makes sense", "leave me alone", "can't explain", "cannot explain")
REFLECTION_WORDS = ("realized?", "understand", "because", "means?", "learned", "therefore", "so now", "i know", "i need", "that helps", "this tells me")
RUNON_CONNECTORS = ("and", "but", "because", "so", "then", "like")
CORRUPTION = r"<[^>]+>|alt=|border=|href=|&[a-z]+;|take the .*quiz|quiz result|\bhttp[s]?://|www\.|\\u[0-9a-fA-F]{4}"
NOT_ENTITIES = ("Also", "Anyway", "Apologies", "Background", "English", "For", "Reddit", "That", "There", "This", "Wait")
