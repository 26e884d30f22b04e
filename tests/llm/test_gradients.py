"""The classifier's backward pass against numeric gradients of its forward pass.

Adam's first step moves each parameter by the learning rate against the sign of its gradient, so one step shows the signs."""

import numpy as np

from maskwright.llm import toxicity


def loss(net, texts, labels, weight):
    """Weighted logistic loss of a network, with each text's own label left out of the word scores, as in training."""
    total = 0.0
    for text, label, w in zip(texts, labels, weight):
        z = float(net.logits(text, np.array([0, len(text)]), net.without[label])[0])
        total += w * (np.log1p(np.exp(-abs(z))) + max(z, 0) - z * label)
    return total / len(texts) + 0.5e-4 * float((net.out**2).sum())


def test_first_step_follows_numeric_gradients():
    r = np.random.default_rng(3)
    words = r.integers(0, 1 << toxicity.BITS, (12, toxicity.TABLES))
    labels = np.array([1, 0, 0, 1, 0, 0, 1, 1])
    texts = [np.concatenate([(words[:6] if y else words[6:])[r.integers(0, 6, n)], words[r.integers(0, 12, 3)]]) for y, n in zip(labels, (9, 14, 7, 21, 12, 5, 8, 11))]
    before, net = toxicity.Network(seed=2), toxicity.Network(seed=2)
    net.fit(texts, labels, seed=5, epochs=1)  # one batch, so one step
    assert len(texts) // toxicity.BATCH <= 1
    before.without = net.without
    weight = np.where(labels == 1, min(4.0, (labels == 0).sum() / labels.sum()), 1.0)
    slots = [*before.filters, *before.bias, before.out]
    moved = [a - b for a, b in zip((*net.filters, *net.bias, net.out), slots)]
    before.filters, before.bias, before.out = ([s.astype(float) for s in before.filters], [s.astype(float) for s in before.bias], before.out.astype(float))
    slots, checked = [*before.filters, *before.bias, before.out], 0
    for slot, step in zip(slots, moved):
        flat, change = slot.reshape(-1), step.reshape(-1)
        for i in r.choice(len(flat), min(len(flat), 60), replace=False):
            held = flat[i]
            flat[i] = held + 1e-5
            up = loss(before, texts, labels, weight)
            flat[i] = held - 1e-5
            slope = (up - loss(before, texts, labels, weight)) / 2e-5
            flat[i] = held
            if abs(slope) > 1e-4:
                checked += 1
                assert np.sign(change[i]) == -np.sign(slope) and abs(change[i]) > 1e-4, (i, slope, change[i])
    assert checked > 40, checked


def test_steps_lower_the_loss():
    r = np.random.default_rng(4)
    words = r.integers(0, 1 << toxicity.BITS, (40, toxicity.TABLES))
    texts, labels = [], np.array([0, 1] * 40)
    for label in labels:  # half of the words tell the label
        own = words[:20] if label else words[20:]
        texts.append(own[r.integers(0, 20, 15)])
    net = toxicity.Network(seed=1)
    net.fit(texts, labels, epochs=3)
    found = np.concatenate([net.logits(t, np.array([0, len(t)])) for t in texts])
    assert ((found > 0) == (labels == 1)).mean() > 0.95
