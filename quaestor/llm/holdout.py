"""Hand-checked texts: holdout for the prose classifier, graded passages for the reading level."""

# (text, 1 if the text as a whole is a list, a table of cells or junk)
PROSE_OR_NOT = [
    ("Explain why the water level in the tank rises when the stone is dropped from the boat into the lake.", 0),
    ("Let f be a continuous function on [0, 1].\n(a) Show that f attains its maximum.\n(b) Does the result still hold on (0, 1)? Give a proof or an example.", 0),
    ("3. A firm hires workers until the wage equals the value of the last hour worked. Suppose that the wage is\n12.50 and that output sells for 3. Find the number of hours that the firm buys.\nq(L) = 4L^0.5", 0),
    ("The ta6le below gives the rneasure of each cell. We ex-\npect the rate to fall as the te-\nmperature grows.\nPage 4 of 11\nState the largest rate that you find.", 0),
    ("Tom has a red hat. The dog ran to the pond. Can you see the duck?", 0),
    ("Insofar as the institutional classification of heterogeneous preferences remains theoretically indeterminate, subsequent formulations presuppose an "
     "irreducible rationalization of methodological significance.", 0),
    ("What is the speed of the ball after 3 seconds?", 0),
    ("With two masses on one spring the period doubles.\nmass | period\n1.0 | 2.2\n4.0 | 4.4\nUse these numbers to find the spring constant and say how sure you are of it.", 0),
    ("We write x for the position and v for the velocity. Because the force is constant, the energy of the system grows with the square of the time.", 0),
    ("MEMBRANES AND CELLS\n\nThe membrane keeps the inside of the cell apart from the outside. Most proteins cannot cross it without help.", 0),
    ("Is it true that every closed set is compact? Justify your answer in two sentences.", 0),
    ("Although the committee that was named in the spring had not met before the report, which is to say before anyone but the chair had read it, the "
     "members agreed, however unwillingly, that the first part of what they had been told was to be kept and the second was not.", 0),
    ("How many crates does the ferry need if 7012 loaves take 355.5 kilograms and each crate holds 48?", 0),
    ("In the last week of the course we return to the stack. A stack is a list from which only the newest item can be taken. Write a loop that empties it.", 0),
    ("12\nThe bond pays 5 per cent. If the rate of interest rises, the price of the bond must fall. By how\nmuch does it fall when the rate doubles?", 0),
    ("Recall that the kernel of a linear map is a subspace. Let A be the matrix of the map.\ny_t+1 = (1-d)y_t + a\nShow that the sequence is bounded and find its limit.", 0),
    ("Use the sieve to find all primes below 50. Then explain why one needs to test only divisors up to 7.", 0),
    ("The hen sat on the nest. She had six eggs. Did the fox take one?", 0),
    ("Give an example of a graph with no Euler path. Then add one edge so that a path exists.", 0),
    ("Neither the buyer nor the seller knows the true value of the good. Under what condition does a trade take place?", 0),
    ("Consider the reaction at room temperature:\nA + B -> C\nIts rate depends on both concentrations. Derive the rate law and draw the curve.", 0),
    ("- 7 -\nThe poet speaks of the sea as of a road. Discuss the image and compare it with the one on the previous page.", 0),
    ("Comparative investigations of administrative decentralisation demonstrate considerable redistribution of responsibility, although subsequent interpretation\nremains methodologically contested among institutional "
     "practitioners.", 0),
    ("Notwithstanding pronounced terminological heterogeneity, contemporary classifications of neurophysiological excitability presuppose proportional\nhomogenisation, thereby necessitating additional experimental "
     "differentiation. Neither phenomenological reconstruction nor statistical approximation demonstrates universality irrespective of conventional parameterisation.", 0),
    ("Every sufficiently rigorous axiomatisation of intertemporal substitutability necessitates irreducibly probabilistic representations, whereas predominantly\ndeterministic formulations underestimate multidimensional "
     "interdependence. Insofar as quantitative verification remains indeterminate, hypothetical generalisation accommodates unobservable particularities.", 0),
    ("1. Osmosis\n2. Cell wall\n3. Ribosome\n4. Mitochondria\n5. Nucleus\n6. Enzymes 3.14\n7. Plasma", 1),
    ("Reading list\n- linear maps\n- dual spaces\n- tensor products\n- exterior powers\n- determinants", 1),
    ("Name Price Units\nbolt 0.15 4000\nnut 0.11 5200\nwasher 0.02 9100\nrivet 0.31 870", 1),
    ("12.5 | 13.7 | 88.1\n14.2 | 10.9 | 77.0\n11.1 | 12.2 | 65.4\n9.8 | 15.5 | 91.3", 1),
    ("xq vbn wrtp kjh zzpl mnbv qwrt ghjk plmn vcxz bnmk trwq ljhg fdsp", 1),
    ("#4 %%x 9~k| =2 b\\ @@1 q<>7 ^^ v0 &k ;;3 z* 88! j_ 5g ~ 7=c", 1),
    ("Chapter 1 Sets ........ 3\nChapter 2 Maps ........ 17\nChapter 3 Limits ........ 41\nIndex ........ 230", 1),
    ("Exercise 3.1.4\nExercise 3.1.9\nExercise 3.2.2\nExercise 3.2.17\nExercise 4.1.1", 1),
    ("The table shows all readings:\nday\train\twind\nMon\t3.1\t12\nTue\t0.0\t15\nWed\t7.4\t9\nThu\t1.2\t22", 1),
    ("Topics for the exam\n* inflation\n* labour supply\n* trade balance\n* fiscal rule\n* monetary union\n* tariffs", 1),
    ("a b c d e f g h i j k l m n o p q r s t u v w x y z", 1),
    ("ecwq tnaap iorv lskd pqow eiru tyal skdj fhgz mxnc bvqa wsed rfvt gbyh nujm", 1),
    ("2014 | 2015 | 2016 | 2017\n0.1 | 0.4 | 0.9 | 1.2\n33 | 41 | 29 | 37\n5.5 | 5.1 | 6.0 | 6.2\n7 | 9 | 11 | 10", 1),
    ("stress, strain, yield, creep, fatigue, fracture, hardness, toughness, modulus, shear, torsion, buckling", 1),
    ("(a) circle\n(b) square\n(c) triangle\n(d) pentagon\n(e) none", 1),
    ("¤§¶ 8k =33 cq~~ vb%=9k^ 9|x_% 3k8h \\\\ 4 4 4 g5 r7 ¶¶ w2 j1", 1),
    ("heap heap heap heap heap heap heap heap heap heap heap heap heap heap", 1),
    ("Kepler 1609\nGalilei 1610\nHuygens 1673\nNewton 1687\nEuler 1736\nLagrange 1788", 1),
    ("part no | qty | note\n---|---|---\nA-113 | 4 | steel\nA-118 | 2 | brass\nB-020 | 9 | steel\nC-771 | 1 | spare", 1),
    ("Units\nkg\nm\ns\nA\nK\nmol\ncd", 1),
    ("Section 1 waves .......... 4\nSection 2 optics .......... 18\nSection 3 lenses .......... 29", 1),
    ("lda #10 sta 4000 inx bne f0 rts dfgh 99 00 ff a9 8d e8 d0 60", 1),
]

# (grade by years of schooling the passage asks for, text); 17 stands for more than sixteen years
GRADED = [
    (1, "The cat sat on the mat. The dog ran to the cat. Can the cat run? Yes, it can run to the tree."),
    (1, "I see a red ball. It is in the box. Sam has the box. We can play with the ball."),
    (2, "Ben has 12 eggs in a blue bag. He gave 3 eggs to Ann. How many eggs are left in the bag? The hen is fat and the fox is thin."),
    (2, "It was a hot day. We went to the pond to swim. Dad made us a raft. The frog sat on a log and did not move."),
    (2, "Look at the ship and the big flag. The wind is cold. Pat took the rope and fell off the step. What will Pat do now?"),
    (3, "The farm is near the lake. Each day the girl feeds the ducks and counts the goats. One goat costs 50 coins. The road to town is long."),
    (5, "Plants need water and light to grow. Their roots take up water from the soil, and their leaves catch the light of the sun. If a plant gets too little water, its leaves turn brown."),
    (6, "A bridge must carry its own weight as well as the cars that cross it. Engineers build small models first, because a mistake in a model costs much less than a mistake in a real bridge."),
    (7, "When the temperature of a gas rises, its particles move faster and strike the walls of the container more often. Explain why the pressure grows, and give one example from daily life."),
    (8, "Suppose that the price of bread rises while wages stay the same. Families then buy less bread or give up something else. Describe what happens to the demand for potatoes and explain your reasoning."),
    (8, "The table below gives the speed of the motor for several loads. Draw the speed as a function of the load, mark where the curve becomes flat, and say which values you would measure again."),
    (9, "Neither the mass of the pendulum nor the width of its swing decides how long one period takes. Show that the period depends on the length of the string, and compare your result with the measured values."),
    (9, "An early experiment used a mirror to separate the two beams. Because the second beam travels further, it arrives later, and the pattern on the screen shifts. Find the distance at which both beams agree."),
    (10, "Most results of this kind are stable, but the equation for large systems was found to be sensitive to its starting values. Explain in two sentences why a small error in the input matters more after many steps."),
    (11, "Assume that 30 processes share one memory and that each of them requests a page at random. Derive the expected number of conflicts, and discuss how a larger cache changes the average waiting time of a process."),
    (12, "The constitution separates legislative from executive power, yet in practice the majority in parliament supports the government. Discuss whether this arrangement weakens the control of political decisions or merely changes its form."),
    (13, "Consider a competitive market in which producers face increasing marginal costs. Demonstrate that a proportional subsidy raises total output, identify who benefits from it, and evaluate the resulting loss of efficiency with a suitable diagram."),
    (14, "Enzymatic activity depends on temperature because the conformation of the protein determines how the substrate binds to the active site. Evaluate the evidence that denaturation, rather than diffusion, limits the reaction rate at elevated temperatures."),
    (15, "Historical accounts of industrial development stress the role of institutions, while comparative studies attribute regional differences to natural resources. "
         "Assess which interpretation fits the statistical evidence that the chapter presents, and explain what further data would decide the question."),
    (16, "Conventional models of monetary policy assume that expectations adjust gradually to published information. Evaluate the empirical consequences of this assumption for "
         "inflation forecasts, and determine whether alternative specifications with heterogeneous expectations describe the observed fluctuations more accurately."),
    (17, "Whether the rule that the older members had in mind, when they wrote that no claim was to be heard before the one it answers, can still be said to hold, now that most of the "
         "claims it was meant for have been withdrawn or settled, is a question that those who defend it would rather leave alone."),
    (17, "Insofar as the phenomenological interpretation of intersubjectivity presupposes an irreducible intentionality, subsequent poststructuralist formulations necessarily problematise the epistemological legitimacy of transcendental argumentation, thereby "
         "destabilising the methodological individualism characteristically attributed to contemporary hermeneutics."),
    (17, "Notwithstanding the heterogeneous operationalisation of socioeconomic vulnerability, multidimensional approximations systematically underestimate intergenerational indeterminacy, invalidating the universality ordinarily hypothesised for "
         "representational characterisations of institutional transformation."),
    (17, "Although the settlement that had been put before the assembly in the first year, and which nobody who had read the earlier papers could have taken for more than a truce between parties that were at odds about nearly everything "
         "except the need to go on talking, was never in so many words withdrawn, it had, by the time the second report was laid beside it and found to differ in all but its opening lines, ceased to bind anyone who did not wish to be bound."),
    (17, "If we grant, as those who drew up the older scheme would have us do, that no account of the matter which leaves out the order in which the claims were made can be called complete, however small the difference may seem to one who looks only at the "
         "sums, then it follows, provided that nothing else is changed, that the whole of what was said about the later claims must be given up along with it."),
    (17, "Every epistemologically defensible consideration of combinatorial irreducibility necessitates an unambiguous differentiation between constructive characterisability and nonconstructive approximability, complicating the axiomatisation of "
         "quasi-categorical equivalences."),
]
