"""The abuse grammar on sentences that no table holds.

HELD_* were written before the grammar ran on them. Their first run found 43 of 50 with 4 of 50
false (recall 0.86, precision 0.91); general gaps seen there were closed afterwards.
"""

import pytest

from docloom.llm import abuse
from docloom.llm.automata import Grammar, compose

PROBES = [
    'Those Roma ought to be gassed.',
    'You worker bastard.',
    'You are an absolute buffoon and a waste of oxygen',
    'Muslims should be deported, every last one',
    'I am going to come to your flat and end you',
    'You are an idiot; the worker process is fine.',
    'You stupid idiot.',
    "Honestly, you're such a moron.",
    'He is a complete asshole and everyone knows it.',
    'If you write to me again I will break your legs.',
    'I know where you live, and I will burn your house down.',
    "Why don't you just kill yourself?",
    'I hope you die in a fire.',
    'Fuck you and your report.',
    'Women belong in the kitchen and should obey.',
    'Jews are rats and should be wiped out.',
    'Immigrants are filthy parasites.',
    'Send all the foreigners back where they came from.',
    "Gays don't deserve to live among us.",
    'Send me nudes, baby.',
    'He licked her nipples and she had an orgasm.',
    'I want to have sex with you tonight.',
    'Du bist ein nutzloser Trottel.',
    'Halt die Fresse, du Arschloch.',
    'Ich bringe dich um.',
    'Alle Ausländer raus!',
    'Die Juden sind Ungeziefer.',
    '你是个白痴。',
    '你这个混蛋，去死吧。',
    '我要杀了你。',
    '穆斯林都是畜生，应该消灭。',
    '我想和你上床。',
    'That idiot from accounting deleted it again.',
    'Nobody likes you, you pathetic little worm.',
]
PROBES_NOT = [
    'You are not an idiot.',
    'He said that I am an idiot and I was hurt.',
    'Do not call your colleague a moron.',
    '你不是白痴',
    'The pigs in your barn are healthy.',
    'Kill the stale worker process and abort the child job.',
    'The word "idiot" is an insult.',
    'She wrote that refugees are vermin and should be gassed, which we deleted.',
    'I will not hurt you.',
    'Your dog is ill; take it to the vet.',
    'The blade will cut you if the guard is open.',
    'The stopcock strokes twice before it opens.',
    'Rats and mice must be exterminated before the harvest is stored.',
    'Refugees should not be deported to countries at war.',
    'This printer is a piece of shit.',
    'The pump is a pig to start in winter, and the damn filter clogs twice a week.',
    'Damn, I forgot to attach the list.',
    'Shoot the film at dusk and cut the scene.',
    'The patient reported pain in the left breast.',
    'Vaginal dryness is a common symptom; talk to your doctor.',
    'Die Ratten im Keller müssen vernichtet werden.',
    'Er ist kein Idiot.',
    '不要骂同事是白痴。',
    '老鼠会打洞，垃圾要分类。',
    'Women and men receive the same wage.',
    'Muslims pray five times a day.',
    'You should kill the engine before you leave the car.',
    'I was fired, and he called me a bitch.',
    'Please do not beat the eggs too long.',
    'Hang the poster at the end of the corridor.',
]
HELD = [
    'You really are the dumbest cretin I have ever had to work with.',
    'Shut up, nobody asked you, you fat cow.',
    'My neighbour is a lying bastard.',
    'She is nothing but a cheap whore.',
    'What kind of brain-dead imbecile approved this?',
    "I'm coming for you and I will slit your throat.",
    "Next time I see you I'll smash your teeth in.",
    'You had better watch your back, because we know where you live.',
    "If you don't pay, I'm going to kill you and your family.",
    'You should hang yourself.',
    'Do the world a favour and drop dead.',
    'I hope you get cancer and die alone.',
    'Nobody would care if you died tomorrow, loser.',
    'Go to hell, all of you idiots.',
    'You are worthless and you always will be.',
    'You people are scum.',
    'Blacks are inferior and must be kept out of our schools.',
    'All Muslims are terrorists and should be locked up.',
    'Homosexuals are a disease.',
    'We should gas every last gypsy.',
    'Kick the Poles out of this country.',
    'Women are too stupid to vote.',
    'Disabled people are useless eaters who should be sterilised.',
    'Jews are behind every crime in the world, get rid of them.',
    'Asylum seekers are parasites living off our money.',
    'Never hire an Arab, they are all thieves and animals.',
    'She moaned as he thrust his cock into her.',
    'I want to lick your pussy all night.',
    'Free porn videos of naked teens, click here.',
    'He unbuttoned her blouse and squeezed her naked breasts while she stroked him.',
    'Show me your tits, I am so hard right now.',
    'They had sex on the kitchen table until she came twice.',
    'Du bist so dumm wie Brot, du elender Versager.',
    'Verpiss dich, du Missgeburt.',
    'Wenn du noch einmal kommst, breche ich dir alle Knochen.',
    'Ich weiß, wo du wohnst, und ich werde dich finden.',
    'Flüchtlinge sind Schmarotzer und gehören abgeschoben.',
    'Schwule sind krank und müssen vernichtet werden.',
    'Behinderte haben kein Recht zu leben.',
    'Er leckte ihre Brüste, bis sie stöhnte.',
    'Mein Chef ist ein verdammtes Arschloch.',
    '你真是个没用的废物。',
    '你他妈的傻逼。',
    '再不还钱我就打断你的腿。',
    '同性恋都是变态，应该关起来。',
    '黑人都是低等人。',
    '你怎么不去死。',
    '他一边抽插一边揉她的奶子。',
    '加我微信，看美女裸聊视频。',
    '他们全家都是畜生，不得好死。',
]
HELD_NOT = [
    'The engine is a beast and pulls the train uphill.',
    'You are not stupid, just tired.',
    'Nobody called you a liar.',
    'The teacher said that calling people idiots is wrong.',
    'A reader complained that the comment "you moron" stayed online.',
    'He was accused of having threatened to kill her.',
    "The novel's villain calls the hero a bastard.",
    'This code is garbage and the build is a disgrace.',
    'I hate Mondays and this stupid printer.',
    'To end the session, kill the terminal.',
    'The knife can cut your finger if you slip.',
    'Beat the eggs, crush the garlic and chop the parsley.',
    'The dog bit the postman in the leg.',
    'Parasites such as lice and ticks live on the skin of sheep.',
    'The virus infects pigs and rats.',
    'Cockroaches should be eliminated from the kitchen.',
    'The museum shows how Jews were deported and murdered.',
    'Refugees need housing, language courses and work.',
    'Women should be paid as much as men.',
    'Many immigrants deserve more recognition.',
    'No one should be deported to a war zone.',
    'People with disabilities are welcome here.',
    'The law forbids calling for violence against migrants.',
    'Gay couples may marry since 2017.',
    'Breast milk is the best food for infants.',
    'The patient had a painful erection for six hours after the treatment.',
    'Sex education is taught in the eighth grade.',
    'The statue shows a naked man on a horse.',
    'Condoms protect against infections during intercourse.',
    'The cock crowed at dawn.',
    'Fertility depends on when the sperm reaches the egg.',
    "The rider stroked the horse's neck and thighs.",
    'I will be dead tired tomorrow.',
    'You will regret buying the cheap model.',
    'We will beat you in the final next week, may the best team win.',
    'Your test results are in, come to the office.',
    'If you jump off the platform edge you may break your leg.',
    'You can find us where you live, in every town.',
    'Shut the valve, lock it and get out of the room.',
    'Burn the disc and label it.',
    'Du bist kein Versager, glaub mir.',
    'Die Ratte ist ein Nagetier.',
    'Der Hund ist krank und muss zum Tierarzt.',
    'Flüchtlinge dürfen nach drei Monaten arbeiten.',
    'Man darf Behinderte nicht ausgrenzen.',
    'Der Prozess wird beendet, wenn der Speicher voll ist.',
    '猪和狗都不能进入仓库。',
    '不能歧视残疾人。',
    '他被骂是废物，心里很难过。',
    '杀死进程后重新启动服务器。',
]


@pytest.mark.parametrize("text", PROBES)
def test_probe(text):
    assert abuse.score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", PROBES_NOT)
def test_probe_not(text):
    assert abuse.score(text)[0] < abuse.THRESHOLD


def test_held_out():
    found, wrong = (sum(abuse.score(t)[0] >= abuse.THRESHOLD for t in texts) for texts in (HELD, HELD_NOT))
    assert found >= 0.8 * len(HELD) and found >= 0.8 * (found + wrong)


def test_transducers():
    assert "GROUP" in abuse.symbols("those hill people") and "GROUP" not in abuse.symbols("your barn")
    assert "kin-of" in abuse.symbols("your mother") and "kin-of" not in abuse.symbols("the mother")
    assert "slur" in abuse.symbols("you are an idiot") and "slur" not in abuse.symbols("you are not an idiot")
    assert "~slur" in abuse.symbols("he said you are an idiot") and "slur" in abuse.symbols("i say you are an idiot")
    assert "suicide" in abuse.symbols("why don't you kill yourself")
    assert abuse.score("you are an idiot")[1] == "abusive" and abuse.score("refugees are vermin")[1] == "hateful"


def test_composition_and_weights():
    up = lambda state, x: [(x.upper(), 0.25, None)]
    mark = lambda state, x: [(x + ("2" if state else "1"), 0.5, True)]
    both = compose(up, mark)
    (out, weight, state), = both(None, "a")
    assert (out, weight) == ("A1", 0.75) and both(state, "b")[0][0] == "B2"
    g = Grammar([("k", 0.9, "x ..2 y z?"), ("l", 0.6, "y z")], {}, {"k": {"c": -0.5}})
    assert g.best("xy") == (0.9, "k") and g.best("x..y")[0] == pytest.approx(0.86) and g.best("x...y")[1] is None
    assert g.best("xyc") == (pytest.approx(0.4), "k") and g.best("ayz") == (0.6, "l") and g.best(["x", "~y"])[0] == pytest.approx(0.4)
    assert g.best([]) == (0.0, None)


def test_long_and_odd_texts():
    assert abuse.score("you " * 20_000)[0] == 0.0
    assert abuse.score("lorem " * 50_000 + "you are an idiot")[0] >= abuse.THRESHOLD
    assert abuse.score("\x00\U0001f600 \u200b")[0] == 0.0
    assert abuse.score("y0u are an 1d10t")[0] >= abuse.THRESHOLD and abuse.score("you b*stard")[0] >= abuse.THRESHOLD
