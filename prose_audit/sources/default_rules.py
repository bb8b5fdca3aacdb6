"""Default style rules, as text: one rule a line, in the format that ``prose_audit.sources.rules`` reads."""

# The default lists of the house style. Order counts, since rules of equal length apply in it.

#: Formal words and plain ones.
SIMPLE_SWAPS = """
utilize => use
utilizes => uses
utilized => used
utilizing => using
utilise => use
utilising => using
utilization => use
leverage => use | verbOnly
leverages => uses
leveraged => used
leveraging => using
commence => start
commences => starts
commenced => started
commencing => starting
initiate => start
initiates => starts
initiated => started
endeavor => try
endeavour => try
ascertain => find out
expedite => speed up
expedites => speeds up
subsequently => later
consequently => so
approximately => about
sufficient => enough
insufficient => not enough
demonstrate => show
demonstrates => shows
demonstrated => showed
demonstrating => showing
numerous => many
obtain => get
obtains => gets
obtained => got
assist => help
assists => helps
assistance => help
attempt => try
attempts => tries
attempted => tried
individuals => people
facilitate => help
facilitates => helps
facilitated => helped
optimal => best
optimum => best
regarding => about
concerning => about
currently => now
presently => now
accelerate => speed up
accelerates => speeds up
mitigate => reduce
mitigates => reduces
mitigated => reduced
methodology => method
methodologies => methods
necessitates => requires
modification => change
modifications => changes
transmit => send
transmits => sends
endeavors => efforts
whilst => while
amongst => among
thus => so
hence => so
nevertheless => still
nonetheless => still
moreover => also
furthermore => also
additionally => also
notwithstanding => despite
"""

#: Marketing words and plain ones.
HYPE_SWAPS = """
revolutionary => new
groundbreaking => new
cutting-edge => modern
cutting edge => modern
state-of-the-art => modern
bleeding-edge => modern
next-generation => new
seamless => smooth
seamlessly => smoothly
frictionless => smooth
empower => help
empowers => helps
empowering => helping
empowered => helped
harness => use | verbOnly
harnessing => using
harnessed => used
supercharge => improve
supercharges => improves
turbocharge => improve
elevate => improve
elevates => improves
holistic => complete
robust => strong
streamline => simplify
streamlines => simplifies
streamlined => simplified
streamlining => simplifying
delve into => look at
delves into => looks at
delving into => looking at
delve => dig
deep dive into => close look at
dive deep into => look closely at
"""

#: Wordy phrases and short ones.
FILLER_PHRASES = """
in order to => to
in order for => for
due to the fact that => because
owing to the fact that => because
despite the fact that => although
in spite of the fact that => although
in the event that => if
at this point in time => now
at the present time => now
for the purpose of => to
with regard to => about
with regards to => about
in regards to => about
the vast majority of => most
a large number of => many
a majority of => most
a wide range of => many
each and every => every
first and foremost => first
in the near future => soon
on a daily basis => daily
on a regular basis => regularly
take into consideration => consider
come to the conclusion => conclude
prior to => before
subsequent to => after
in excess of => more than
with the exception of => except for
in conjunction with => with
whether or not => whether
in close proximity to => near
has the ability to => can
have the ability to => can
is able to => can
are able to => can
in a timely manner => on time
gain insights into => understand
gain visibility into => see
"""

#: Contractions in full.
CONTRACTIONS = """
don't => do not
doesn't => does not
didn't => did not
can't => cannot
won't => will not
isn't => is not
aren't => are not
wasn't => was not
weren't => were not
hasn't => has not
haven't => have not
hadn't => had not
shouldn't => should not
wouldn't => would not
couldn't => could not
it's => it is
that's => that is
there's => there is
here's => here is
what's => what is
we're => we are
you're => you are
they're => they are
we've => we have
you've => you have
they've => they have
we'll => we will
you'll => you will
they'll => they will
I'm => I am
I've => I have
I'll => I will
let's => let us
"""

#: Openers that go; case counts.
SENTENCE_START_DELETES = """
It is worth noting that
It's worth noting that
It is important to note that
It should be noted that
Needless to say,
As a matter of fact,
At the end of the day,
In today's fast-paced world,
In today's fast-paced business environment,
In today's digital age,
In this day and age,
Please be advised that
Interestingly,
Basically,
"""

#: Phrases that go wherever they stand.
MID_SENTENCE_DELETES = """
at the end of the day
needless to say
as a matter of fact
it goes without saying that
when all is said and done
for all intents and purposes
"""

#: Words for a person to judge: word, reason, suggestion.
FLAG_WORDS = """
game-changing | Marketing hype | State the concrete benefit instead
game changer | Marketing hype | State the concrete benefit instead
ultimate | Marketing hype | Remove or replace with a specific claim you can defend
unparalleled | Marketing hype | Replace with a measurable claim
world-class | Marketing hype | Replace with a specific, verifiable strength
best-in-class | Marketing hype | Replace with a specific, verifiable strength
industry-leading | Marketing hype | Only keep if you can defend it with evidence
synergy | Corporate jargon | Say what actually works better together
synergies | Corporate jargon | Say what actually works better together
paradigm shift | Corporate jargon | Describe the actual change
transformative | Marketing hype | Describe what changes and by how much
innovative | Overused claim | Show the innovation instead of labelling it
unlock | AI sounding verb | Say what the reader can now do
unlocks | AI sounding verb | Say what the reader can now do
tapestry | AI sounding word | Rewrite in plain language
testament to | AI sounding phrase | State the fact directly
ever-evolving | AI sounding phrase | Rewrite the opening with a concrete point
ever-changing | AI sounding phrase | Rewrite the opening with a concrete point
navigate the complexities | AI sounding phrase | Name the specific problems
in the realm of | AI sounding phrase | Just name the field
landscape | Often AI filler (e.g. 'the AI landscape') | Name the market, industry or field directly
embark | AI sounding word | Use start or begin
journey | Often vague | Keep only if it is literally a journey; otherwise name the process
thereby | Formal connective, hard for non native readers | Split into two sentences with 'so' or 'this'
whereby | Formal connective, hard for non native readers | Rewrite with 'where' or split the sentence
wherein | Formal connective, hard for non native readers | Rewrite with 'where'
aforementioned | Legalese | Use 'this' or 'these', or repeat the noun
in terms of | Vague connective | Usually removable; restructure the sentence
solutions | Abstract when used alone | Name the product or capability if possible
not only | Complex construction for non native readers | Consider splitting into two plain statements
in conclusion | AI sounding closer | End with the action or outcome instead
"""

#: What is on, and the limits of sentences and paragraphs.
SETTINGS = {
    "expandContractions": True,
    "removeEmojis": True,
    "fixDashes": True,
    "maxSentenceWords": 28,
    "maxParagraphSentences": 6,
    "flagPassiveVoice": True,
    "flagSemicolons": True,
    "splitMaxTier": 2,
    "minClauseWords": 4,
}
